"""Queries of the operators that the queries over whole tables (queries.py) don't reach: ids and keys, offsets, registries, orders
of results, error rows, annotators, pipeline stages and the neural part. Weights and rules are made up and whole numbers, so
that SQL can say what comes out."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import EngineError
from .functions import hashing, lexical, vectors
from .operators import annotators, batches, dependency_matcher, entities, neural, phrase_matcher, rulers, token_matcher, trees
from .operators.kernels import per_document
from .operators.tokenizer import TokenizerRules, tokenize, tokenize_regex_docs
from .plans import patterns, pipeline, predicates
from .queries import _HEAP, _IN, _INDEX, _NEXT, _RIGHT_HEADS, _RUNS, FUNCTION, WINDOW, _docs_for_search, _item, _search, docs_of, heap_docs, query, right_docs, tok, with_tok
from .schema import DOC, DOC_DDL, byte_of_codepoint, codepoint_of_byte, explode_tokens, span_text
from .sources import model, snapshot

_LOW = lambda *v: _item("lower", "in", list(v))
_ROW = 'SELECT doc_id, label, a::INTEGER AS start, b::INTEGER AS "end" FROM '


def _values(rows: list[tuple], names: str) -> str:
    """SQL for a constant table of strings and integers."""
    cell = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS v({names})"


def _outcome(f) -> str:
    """ok, or the code of the error that f raises."""
    try:
        f()
    except EngineError as e:
        return e.code
    return "ok"


def model_docs(spark, d, fill) -> DataFrame:
    """Documents of the model with the words of the regular tokenization, as fill(doc_id, tokens, document) sets them up."""
    fields = ("norm", "tag", "pos", "morphology", "lemma", "head", "dep", "sentence_start", "entity_iob", "entity_type", "entity_id")

    def run(row: dict) -> list[dict]:
        tokens, at, idx = [], 0, 0
        for w in row["words"] or []:
            size = len(w.encode())
            tokens.append({"start": at, "end": at + size, "idx": idx, "whitespace": False, **dict.fromkeys(fields), "norm": w.lower()})
            at, idx = at + size, idx + len(w)
        doc = dict.fromkeys(DOC) | {"doc_id": row["doc_id"], "text": "".join(row["words"] or []), "tokens": tokens, "tensor": [], "span_groups": []}
        fill(row["doc_id"], tokens, doc)
        return [doc]

    return per_document(_docs_for_search(spark, d), run, DOC_DDL)


_N = "nn AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id)"

# ---- ids and keys --------------------------------------------------------------------------------------------------

_MUL = "((({0})::UHUGEINT * {1}::UHUGEINT) % 18446744073709551616)::UBIGINT"
_ADD = "((({0})::UHUGEINT + ({1})::UHUGEINT) % 18446744073709551616)::UBIGINT"
_M = "14313749767032793493"


def _times(a: str, b: str = _M) -> str:
    return _MUL.format(a, b)


def _folded(a: str, shift: int) -> str:
    return f"xor({a}, ({a}) >> {shift})"


def hash_sql(strings: str) -> str:
    """CTEs that end in ids(text, id): the 64-bit hash of every text of a CTE `strings`, block by block of eight bytes."""
    little = "('0x' || array_to_string(list_transform(range({1}), lambda q: substr(hx, 16 * {0} + 2 * ({1} - 1 - q) + 1, 2)), ''))::UBIGINT"
    return (
        f"s0 AS (SELECT DISTINCT text FROM {strings} WHERE text <> ''), s1 AS (SELECT text, hex(encode(text)) AS hx, strlen(text) AS n FROM s0),"
        f" s2 AS (SELECT text, hx, n, xor(1::UBIGINT, {_times('n')}) AS h, list_transform(range(n // 8), lambda j: {little.format('j', '8')}) AS ks, CASE WHEN n % 8 > 0 THEN {little.format('(n // 8)', '(n % 8)')} END AS tail FROM s1),"
        f" s3 AS (SELECT text, tail, list_reduce(list_transform(ks, lambda k: {_times(_folded(_times('k'), 47))}), lambda a, k: {_times('xor(a, k)')}, h) AS h FROM s2),"
        f" s4 AS (SELECT text, CASE WHEN tail IS NULL THEN h ELSE {_times('xor(h, tail)')} END AS h FROM s3), s5 AS (SELECT text, {_times(_folded('h', 47))} AS h FROM s4),"
        f" ids AS (SELECT text, {_folded('h', 47)} AS id FROM s5)"
    )


def _words(spark, d) -> DataFrame:
    return tok(spark, d).select("text").distinct()


def _numbered(df: DataFrame, make) -> DataFrame:
    """text and value (a string) of every row by make(text)."""
    return per_document(df.select("text"), lambda r: [{"text": r["text"], "value": make(r["text"])}], "text string, value string")


query("string_ids", with_tok("SELECT text, id::VARCHAR AS value FROM ids", hash_sql("tok")))(lambda spark, d: _numbered(_words(spark, d), lambda t: str(hashing.murmur64a(t))))

_SYMBOLS = {"the": 5, "of": 77}
query("string_ids_symbols", with_tok("SELECT text, CASE text WHEN 'the' THEN '5' WHEN 'of' THEN '77' ELSE id::VARCHAR END AS value FROM ids", hash_sql("tok")))(
    lambda spark, d: _numbered(_words(spark, d), lambda t: str(hashing.string_id(t, _SYMBOLS)))
)


def keys_sql(source: str, seed: int, name: str) -> str:
    """CTEs that end in `name` (id, k1..k4): the four keys of every id of a CTE."""
    fold = lambda a: _folded(a, 33)
    f1, f2 = "18397679294719823053", "14181476777654086739"
    steps = [
        f"{name}0 AS (SELECT DISTINCT id, {_times('id', '9782798678568883157')} AS x FROM {source})",
        f"{name}1 AS (SELECT id, {_times(_ADD.format(_times('x', str(1 << 31)), 'x >> 33'), '5545529020109919103')} AS x FROM {name}0)",
        f"{name}2 AS (SELECT id, {_ADD.format(f'xor(x, {seed ^ 8}::UBIGINT)', f'{seed ^ 8}::UBIGINT')} AS a FROM {name}1)",
        f"{name}3 AS (SELECT id, a, {_ADD.format('a', f'{seed ^ 8}::UBIGINT')} AS b FROM {name}2)",
        f"{name}4 AS (SELECT id, {_times(fold('a'), f1)} AS a, {_times(fold('b'), f1)} AS b FROM {name}3)",
        f"{name}5 AS (SELECT id, {_times(fold('a'), f2)} AS a, {_times(fold('b'), f2)} AS b FROM {name}4)",
        f"{name}6 AS (SELECT id, {fold('a')} AS a, {fold('b')} AS b FROM {name}5)",
        f"{name}7 AS (SELECT id, {_ADD.format('a', 'b')} AS a, b FROM {name}6)",
        f"{name}8 AS (SELECT id, a, {_ADD.format('a', 'b')} AS b FROM {name}7)",
        f"{name} AS (SELECT id, a & 4294967295 AS k1, a >> 32 AS k2, b & 4294967295 AS k3, b >> 32 AS k4 FROM {name}8)",
    ]
    return ", ".join(steps)


@query("table_keys", with_tok("SELECT text, k1::VARCHAR || ',' || k2::VARCHAR || ',' || k3::VARCHAR || ',' || k4::VARCHAR AS value FROM ids JOIN ky USING (id)", f"{hash_sql('tok')}, {keys_sql('ids', 9, 'ky')}"))
def table_keys(spark, d):
    """The four table keys of every word's id."""
    return _numbered(_words(spark, d), lambda t: ",".join(map(str, hashing.table_keys(np.array([hashing.string_id(t)], dtype=np.uint64), 9)[0].tolist())))


_NORMS = {"the": "THE", "of": "o'"}


@query("lex_norm", with_tok("SELECT DISTINCT text, CASE text WHEN 'the' THEN 'THE' WHEN 'of' THEN 'o''' ELSE lower(text) END AS value FROM tok"))
def lex_norm(spark, d):
    lexicon = lexical.Lexicon(norms=_NORMS)
    return _numbered(_words(spark, d), lambda t: lexical.norm(t, lexicon))


_FOUR = "w4 AS (SELECT DISTINCT text, lower(text) AS f1, left(text, 1) AS f2, right(text, 3) AS f3, {shape} AS f4 FROM tok), strings AS (SELECT f1 AS text FROM w4 UNION SELECT f2 FROM w4 UNION SELECT f3 FROM w4 UNION SELECT f4 FROM w4)"


def _features_sql() -> str:
    from .queries import _SHAPE_SQL

    return _FOUR.format(shape=f"CASE WHEN length(text) >= 100 THEN 'LONG' ELSE {_SHAPE_SQL} END") + ", " + hash_sql("strings")


_IDS4 = "FROM w4 JOIN ids a ON a.text = f1 JOIN ids b ON b.text = f2 JOIN ids c ON c.text = f3 JOIN ids e ON e.text = f4"


@query("neural_features", with_tok(f"SELECT w4.text, a.id::VARCHAR || ',' || b.id::VARCHAR || ',' || c.id::VARCHAR || ',' || e.id::VARCHAR AS value {_IDS4}", _features_sql()))
def neural_features(spark, d):
    """The ids of norm, first character, last three characters and shape."""
    return _numbered(_words(spark, d), lambda t: ",".join(map(str, neural.feature_ids([t], [t.lower()])[0].tolist())))


_LEXEME = ("text", "orth", "lower", "norm", "prefix", "suffix", "shape", "length", "has_vector", "is_alpha", "is_ascii", "is_digit", "is_lower", "is_upper", "is_title", "is_punct", "is_space", "is_currency", "is_bracket", "is_quote", "is_left_punct", "is_right_punct", "is_stop", "like_num")


def _lexeme_sql() -> str:
    from .queries import _BARE, _FLAGS_SQL, _SHAPE_SQL

    signed = "CASE WHEN id >= 9223372036854775808 THEN (id::HUGEINT - 18446744073709551616)::BIGINT ELSE id::BIGINT END"
    sets = {"is_bracket": lexical.BRACKETS, "is_quote": lexical.QUOTES, "is_left_punct": lexical.LEFT_PUNCT, "is_right_punct": lexical.RIGHT_PUNCT}
    inside = ", ".join(f"text IN ({_IN(v)}) AS {k}" for k, v in sets.items())
    number = f"regexp_full_match({_BARE}, '[0-9]+') OR regexp_full_match({_BARE}, '[0-9]+/[0-9]+') OR lower({_BARE}) IN ({_IN(lexical.NUMBER_WORDS)}) OR regexp_full_match(lower({_BARE}), '[0-9]+(st|nd|rd|th)')"
    shape = f"CASE WHEN length(text) >= 100 THEN 'LONG' ELSE {_SHAPE_SQL} END AS shape"
    return f"SELECT text, {signed} AS orth, lower(text) AS lower, lower(text) AS norm, left(text, 1) AS prefix, right(text, 3) AS suffix, {shape}, length(text)::INTEGER AS length, false AS has_vector, {_FLAGS_SQL}, {inside}, lower(text) IN ({_IN(sorted(lexical.STOP_WORDS))}) AS is_stop, {number} AS like_num FROM ids"


@query("lexeme_dim", with_tok(_lexeme_sql(), hash_sql("tok")))
def lexeme_dim(spark, d):
    """The lexical record of every word, by the exact functions and not by expressions."""
    return lexical.lexemes(tok(spark, d)).select(*_LEXEME)


_ROWS = 7
_TABLE = np.array([[r, r * r % 5] for r in range(_ROWS)], dtype=np.float32)
_TAG_W = np.array([[1, 0, -1, 0, 0, 1, 0, 0], [0, 1, 0, -1, 1, 0, 0, 0], [0, 0, 1, 0, 0, 0, -1, 1]], dtype=np.float32)
_TAG_B = np.array([0, 1, -1], dtype=np.float32)
_LABELS = ("AA", "BB", "CC")


def _embedded_sql() -> str:
    """x (text, x0..x7): the embedding of every word by the table above; then its scores and best label."""
    row = lambda key, dim: f"({key} % {_ROWS})::BIGINT" if dim == 0 else f"(({key} % {_ROWS}) * ({key} % {_ROWS}) % 5)::BIGINT"
    dims = ", ".join(" + ".join(row(f"q{f}.k{k}", dim) for k in (1, 2, 3, 4)) + f" AS x{2 * f + dim}" for f in range(4) for dim in (0, 1))
    keyed = " ".join(f"JOIN ky{f} q{f} ON q{f}.id = {t}.id" for f, t in enumerate("abce"))
    x = f"xs AS (SELECT w4.text, {dims} {_IDS4} {keyed})"
    score = lambda k: " + ".join(f"{int(v)} * x{j}" for j, v in enumerate(_TAG_W[k]) if v) + f" + {int(_TAG_B[k])}"
    best = f"sc AS (SELECT text, {', '.join(f'{score(k)} AS s{k}' for k in range(3))} FROM xs), lb AS (SELECT text, CASE WHEN s0 >= s1 AND s0 >= s2 THEN 'AA' WHEN s1 >= s2 THEN 'BB' ELSE 'CC' END AS label FROM sc)"
    return f"{_features_sql()}, {', '.join(keys_sql('ids', 3 + f, f'ky{f}') for f in range(4))}, {x}, {best}"


@query("neural_embed", with_tok("SELECT text, " + " || ',' || ".join(f"x{j}::VARCHAR" for j in range(8)) + " AS value FROM xs", _embedded_sql()))
def neural_embed(spark, d):
    """Every word's embedding: four rows of a table for each feature, added up."""
    embed = lambda t: neural.hash_embed(neural.feature_ids([t], [t.lower()]), [_TABLE] * 4, [3, 4, 5, 6])[0]
    return _numbered(_words(spark, d), lambda t: ",".join(str(int(x)) for x in embed(t)))


def _pipeline(spark, d) -> pipeline.Pipeline:
    rules = [annotators.AttributeRule(([_item("tag", "equals", "BB")],), {"pos": "NOUN"}), annotators.AttributeRule(([_LOW("the", "a")],), {"pos": "DET"})]
    tables = annotators.LemmaTables(index={"noun": frozenset(_INDEX)}, rules={"noun": (("s", ""),)})
    chain = neural.Scorer(np.zeros((1, 1, 1, 8), np.float32), np.zeros((1, 1, 1), np.float32), np.ones((1, 1), np.float32), np.array([[1], [2], [3]], np.float32), np.zeros(3, np.float32))
    return pipeline.Pipeline({
        "tokenizer": lambda docs: docs,
        "tok2vec": neural.tok2vec_stage([_TABLE] * 4, [3, 4, 5, 6]),
        "tagger": neural.tagger_stage(_TAG_W, _TAG_B, _LABELS),
        "parser": neural.parser_stage(chain, ["S", "D", "R-dep"]),
        "attribute_ruler": lambda docs: annotators.attribute_ruler(docs, rules),
        "lemmatizer": lambda docs: annotators.lemmatize(docs, tables),
    })


@query("pipeline_tagger", with_tok("SELECT doc_id, label AS tag, count(*) AS n, sum(i)::BIGINT AS places FROM tok JOIN lb USING (text) GROUP BY ALL", _embedded_sql()))
def pipeline_tagger(spark, d):
    """The pipeline up to the tagger: embeddings as tensors, the best label of every token."""
    t = batches.tokens_only(_pipeline(spark, d).process(batches.words_as_docs(_docs_for_search(spark, d)), until="tagger"), "tag string")
    return t.groupBy("doc_id", "tag").agg(F.count("*").alias("n"), F.sum("i").alias("places"))


_POS = "ps AS (SELECT doc_id, i, text, CASE WHEN lower(text) IN ('the', 'a') THEN 'DET' WHEN label = 'BB' THEN 'NOUN' END AS pos FROM tok JOIN lb USING (text))"
_LEMMA_S = f"CASE WHEN pos = 'NOUN' THEN CASE WHEN low LIKE '%s' AND length(low) > 1 THEN left(low, length(low) - 1) ELSE text END ELSE low END"
_LEMMAS = f"lm AS (SELECT doc_id, i, pos, {_LEMMA_S} AS lemma FROM (SELECT *, lower(text) AS low FROM ps))"


@query("pipeline_whole", with_tok("SELECT doc_id, coalesce(pos, '') AS pos, count(*) AS n, sum(greatest(i - 1, 0))::BIGINT AS heads, count(DISTINCT lemma) AS lemmas, sum(length(lemma))::BIGINT AS chars FROM lm GROUP BY ALL", f"{_embedded_sql()}, {_POS}, {_LEMMAS}"))
def pipeline_whole(spark, d):
    """All stages: tags, a chain of heads, attribute rules and lemmas."""
    t = batches.tokens_only(_pipeline(spark, d).process(batches.words_as_docs(_docs_for_search(spark, d))), "pos string, head int, lemma string")
    return t.groupBy("doc_id", F.coalesce("pos", F.lit("")).alias("pos")).agg(F.count("*").alias("n"), F.sum("head").alias("heads"), F.countDistinct("lemma").alias("lemmas"), F.sum(F.length("lemma")).alias("chars"))


def _kernel(spark, d, f, ddl: str) -> DataFrame:
    return per_document(_docs_for_search(spark, d), lambda row: f(row["doc_id"], row["words"] or []), ddl)


@query("neural_parser", with_tok("SELECT doc_id, i::INTEGER AS i, greatest(i - 1, 0)::INTEGER AS head, CASE WHEN i = 0 THEN 'ROOT' ELSE 'dep' END AS dep FROM tok"))
def neural_parser(spark, d):
    """A scorer that likes arcs to the right best and shifting least: every token hangs on the one before."""
    scorer = neural.Scorer(np.zeros((1, 1, 1, 1), np.float32), np.zeros((1, 1, 1), np.float32), np.ones((1, 1), np.float32), np.array([[1], [2], [3]], np.float32), np.zeros(3, np.float32))

    parsed = neural.arcs_stage(scorer, ["S", "D", "R-dep"], lambda batch: np.zeros((len(batch.words), 1), np.float32))
    return batches.tokens_only(parsed(batches.words_as_docs(_docs_for_search(spark, d))), "head int, dep string")


_THES = "th AS (SELECT doc_id, i, n, row_number() OVER (PARTITION BY doc_id, i - r ORDER BY i) % 2 = 1 AND i + 1 < n AS open FROM (SELECT doc_id, i, n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM tok JOIN nn USING (doc_id) WHERE lower(text) = 'the'))"


@query("neural_ner", with_tok("SELECT doc_id, i::INTEGER AS i, CASE WHEN open THEN 'B' WHEN before THEN 'I' ELSE 'O' END AS iob, CASE WHEN open OR before THEN 'E' ELSE '' END AS kind FROM (SELECT doc_id, i, coalesce(open, false) AS open, coalesce(lag(open) OVER (PARTITION BY doc_id ORDER BY i), false) AS before FROM tok LEFT JOIN th USING (doc_id, i))", f"{_N}, {_THES}"))
def neural_ner(spark, d):
    """Entities of two tokens that begin at "the" (the second "the" of two is inside): opened where one may begin, else outside."""
    # Actions O, B-E, I-E, L-E; a token's one feature is 1 for "the". B scores above O there, L above I, so an entity ends at once.
    scorer = neural.Scorer(np.array([[[[2.0]]]], np.float32), np.zeros((1, 1, 1), np.float32), np.zeros((1, 1), np.float32), np.array([[0], [1], [0], [0]], np.float32), np.array([1, 0, 0, 3], np.float32))

    def run(k, words):
        x = np.array([[w.lower() == "the"] for w in words], np.float32).reshape(-1, 1)
        tags = neural.recognise(x, scorer, ["O", "B-E", "I-E", "L-E"]) if len(words) else []
        return [{"doc_id": k, "i": i, "iob": iob, "kind": kind} for i, (iob, kind) in enumerate(tags)]

    return _kernel(spark, d, run, "doc_id bigint, i int, iob string, kind string")


_X2 = "x2 AS (SELECT doc_id, i, length(text)::INTEGER AS a, (i % 5)::INTEGER AS b FROM tok)"


@query("neural_maxout", with_tok("SELECT doc_id, sum(greatest(2 * a - b, b + 1))::BIGINT AS first, sum(greatest(-a, 3 * b - a))::BIGINT AS second FROM x2 GROUP BY doc_id", _X2))
def neural_maxout(spark, d):
    """The best of two pieces for each of two outputs, over a word's length and place."""
    w = np.array([[[2, -1], [0, 1]], [[-1, 0], [-1, 3]]], np.float32)
    b = np.array([[0, 1], [0, 0]], np.float32)

    def run(k, words):
        if not words:
            return []
        y = neural.maxout(np.array([[len(t), i % 5] for i, t in enumerate(words)], np.float32), w, b).astype(np.int64).sum(axis=0)
        return [{"doc_id": k, "first": int(y[0]), "second": int(y[1])}]

    return _kernel(spark, d, run, "doc_id bigint, first bigint, second bigint")


@query("neural_window", with_tok("SELECT doc_id, i::INTEGER AS i, (a + CASE WHEN coalesce(lag(a) OVER w, 0) - coalesce(lead(a) OVER w, 0) >= 0 THEN 1 ELSE -1 END * CASE WHEN coalesce(lag(a) OVER w, 0) = coalesce(lead(a) OVER w, 0) THEN 0 ELSE 1 END)::INTEGER AS x FROM x2 WINDOW w AS (PARTITION BY doc_id ORDER BY i)", _X2))
def neural_window(spark, d):
    """One residual block over a window of three: the sign of what the neighbours differ by, as layer norm leaves it of (v, -v)."""
    w = np.zeros((2, 2, 6), np.float32)
    w[0, 0, 0], w[0, 0, 4], w[1, 0, 0], w[1, 0, 4] = 1, -1, -1, 1
    w[:, 1] = w[:, 0]
    layer = neural.EncoderLayer(w, np.zeros((2, 2), np.float32), np.ones(2, np.float32), np.zeros(2, np.float32))

    def run(k, words):
        if not words:
            return []
        x = neural.encode(np.array([[len(t), 0] for t in words], np.float32), [layer])
        return [{"doc_id": k, "i": i, "x": int(round(float(v)))} for i, v in enumerate(x[:, 0])]

    return _kernel(spark, d, run, "doc_id bigint, i int, x int")


@query("deprojectivize", with_tok("SELECT doc_id, i::INTEGER AS i, (CASE WHEN k = 3 THEN i - 2 WHEN k = 0 THEN i ELSE i - k END)::INTEGER AS head, CASE k WHEN 0 THEN 'ROOT' WHEN 1 THEN 'obj' WHEN 2 THEN 'mark' ELSE 'amod' END AS dep FROM (SELECT doc_id, i, i % 4 AS k FROM tok)"))
def deprojectivize(spark, d):
    """Of four tokens the last is labelled amod||obj: it moves from the first to the second, which has the label."""

    def run(k, words):
        heads, labels = neural.deprojectivize([i - i % 4 for i in range(len(words))], [("ROOT", "obj", "mark", "amod||obj")[i % 4] for i in range(len(words))], [False] * len(words))
        return [{"doc_id": k, "i": i, "head": h, "dep": v} for i, (h, v) in enumerate(zip(heads, labels, strict=True))]

    return _kernel(spark, d, run, "doc_id bigint, i int, head int, dep string")


# ---- texts and offsets ---------------------------------------------------------------------------------------------


@query("token_text", "SELECT doc_id, length(text)::BIGINT AS chars, strlen(text)::BIGINT AS bytes FROM documents WHERE length(text) > 0")
def token_text(spark, d):
    """Tokens and the blanks after them make up the text, in characters and in bytes."""
    t = explode_tokens(tokenize_regex_docs(docs_of(spark, d)))
    blank = F.col("whitespace").cast("int")
    return t.groupBy("doc_id").agg(F.sum(F.length("text") + blank).alias("chars"), F.sum(F.octet_length("text") + blank).alias("bytes"))


_THREE = "^[a-zA-Z]+ [a-zA-Z]+ [a-zA-Z]+ "


@query("span_text", f"SELECT doc_id, regexp_extract(text, '^[a-zA-Z]+ [a-zA-Z]+ [a-zA-Z]+') AS three, '' AS none FROM documents WHERE regexp_matches(text, '{_THREE}')")
def span_texts(spark, d):
    docs = tokenize_regex_docs(docs_of(spark, d).where(F.col("text").rlike(_THREE)))
    span = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    docs = docs.withColumns({"first": span(0, 3), "empty": span(2, 2)})
    return docs.select("doc_id", span_text(span="first").alias("three"), span_text(span="empty").alias("none"))


@query("offsets", "SELECT doc_id, strlen(left(text, k))::INTEGER AS byte, k::INTEGER AS back, CASE WHEN strlen(substr(text, k + 1, 1)) > 1 THEN NULL ELSE (k + 1)::INTEGER END AS next FROM (SELECT *, length(text) // 2 AS k FROM documents) WHERE length(text) > 0")
def offsets(spark, d):
    """The byte offset of a text's middle, back to characters; one byte on is null within a character."""
    docs = docs_of(spark, d).where("length(text) > 0").withColumn("byte", byte_of_codepoint(F.col("text"), F.floor(F.length("text") / 2).cast("int")))
    return docs.select("doc_id", "byte", codepoint_of_byte(F.col("text"), F.col("byte")).alias("back"), codepoint_of_byte(F.col("text"), F.col("byte") + 1).alias("next"))


# ---- predicates and patterns: what compiles, what documents need ---------------------------------------------------

_MORPHS = [(None, None), ("", None), ("Case=Acc,Nom|Number=Sing", None), ("Number=Sing|Case=Nom", "unsupported"), ("Case=Nom,Acc", "unsupported"), ("pos=noun", "unsupported"), ("POS=NOUN", None), ("_", "unsupported"), ("Case", "unsupported"), ("Case=A|Case=B", "unsupported")]


@query("morph_canonical", "SELECT doc_id, (list_value(" + ", ".join("NULL" if e is None else f"'{e}'" for _, e in _MORPHS) + f"))[1 + doc_id % {len(_MORPHS)}] AS error FROM documents")
def morph_canonical(spark, d):
    """Whether a document's morphology is canonical, as matching needs it."""

    def run(row: dict) -> list[dict]:
        got = _outcome(lambda: predicates.check_document_morph(_MORPHS[row["doc_id"] % len(_MORPHS)][0]))
        return [{"doc_id": row["doc_id"], "error": None if got == "ok" else got}]

    return per_document(docs_of(spark, d).select("doc_id"), run, "doc_id bigint, error string")


def _constraint(attribute, kind, value, **more):
    return {"constraints": [{"attribute": attribute, "predicate": {"kind": kind, ("values" if isinstance(value, list) else "value"): value, **more}}]}


_SPECS = [
    ("a string", _constraint("lower", "equals", "the"), "ok"), ("a flag", _constraint("is_digit", "flag", True), "ok"), ("a flag as a string", _constraint("is_digit", "equals", "true"), "pattern"), ("a length", _constraint("length", "compare", 3, operator=">"), "ok"),
    ("a length by name", _constraint("length", "equals", "3"), "pattern"), ("no operator", _constraint("length", "compare", 3), "pattern"), ("an unknown attribute", _constraint("colour", "equals", "red"), "pattern"), ("an integer set", _constraint("length", "in_integers", [1, 2]), "ok"),
    ("strings in it", _constraint("length", "in_integers", ["a"]), "pattern"), ("features of a lemma", _constraint("lemma", "morph_superset", ["A=b"]), "pattern"), ("features", _constraint("morphology", "morph_superset", ["A=b"]), "ok"), ("malformed features", _constraint("morphology", "in", ["A"]), "pattern"),
    ("a range", _constraint("text", "equals", "x") | {"repetition": {"kind": "range", "min": 2, "max": 3}}, "ok"), ("a range that ends first", _constraint("text", "equals", "x") | {"repetition": {"kind": "range", "min": 3, "max": 2}}, "pattern"),
    ("too many nodes", _constraint("text", "equals", "x") | {"repetition": {"kind": "range", "min": 5000}}, "pattern"), ("an unknown repetition", _constraint("text", "equals", "x") | {"repetition": {"kind": "twice"}}, "pattern"),
]


@query("pattern_compile", _values([(n, e) for n, _, e in _SPECS], "name, outcome"))
def pattern_compile(spark, d):
    """Patterns given as rows of JSON: which compile, and the error of those that don't."""
    rows = spark.createDataFrame([(n, json.dumps(s)) for n, s, _ in _SPECS], "name string, spec string")
    return per_document(rows, lambda r: [{"name": r["name"], "outcome": _outcome(lambda: patterns.Pattern.of([json.loads(r["spec"])]))}], "name string, outcome string")


@query("matcher_needs_lexicon", _values([("without", "pattern"), ("with", "ok")], "lexicon, outcome"))
def matcher_needs_lexicon(spark, d):
    spec = [[_constraint("is_digit", "flag", True)]]
    rows = [(n, _outcome(lambda x=x: token_matcher.TokenMatcher(x).add("r", spec))) for n, x in (("without", None), ("with", lexical.Lexicon()))]
    return spark.createDataFrame(rows, "lexicon string, outcome string")


def _lemmas_of_some(k, tokens, doc) -> None:
    """Of three documents one has all lemmas, one none, one that of its first token."""
    for t in tokens[: (len(tokens), 0, 1)[k % 3]]:
        t["lemma"] = t["norm"]


@query("pred_presence", with_tok("SELECT doc_id, i::INTEGER AS start, NULL::VARCHAR AS error FROM tok WHERE lower(text) = 'the' AND (doc_id % 3 = 0 OR doc_id % 3 = 2 AND i = 0) UNION ALL SELECT doc_id, NULL, 'missing_annotation' FROM nn WHERE doc_id % 3 = 1", _N))
def pred_presence(spark, d):
    """Equality on lemmas needs a document in which at least one token has one."""
    m = token_matcher.TokenMatcher().add("r", [[_item("lemma", "equals", "the")]])
    return m.find(model_docs(spark, d, _lemmas_of_some), errors=True).select("doc_id", "start", "error")


# ---- token rules ---------------------------------------------------------------------------------------------------

_SPAN = 'SELECT doc_id, {0} AS rule, {1}::INTEGER AS start, {2}::INTEGER AS "end" FROM '


def _found(df: DataFrame, *more: str) -> DataFrame:
    return df.select("doc_id", *more, "rule", "start", "end")


@query("tm_registry", with_tok(_SPAN.format("'x'", "i", "i + 1") + "tok WHERE lower(text) IN ('the', 'of')"))
def tm_registry(spark, d):
    """Patterns are added to a rule, another rule comes and goes; what changed is a new matcher."""
    m = token_matcher.TokenMatcher().add("x", [[_LOW("the")]]).add("y", [[_LOW("and")]])
    more = m.add("x", [[_LOW("of")]]).remove("y")
    assert len(m) == 2 and "y" in m and "y" not in more and m.remove_all(["y", "z"]).get("x") == m.get("x")
    return _found(_search(spark, d, more))


@query("tm_options", with_tok("SELECT doc_id, x::INTEGER AS start, y::INTEGER AS \"end\" FROM (SELECT doc_id, b, unnest(generate_series(a, b - 1)) AS x FROM runs) r, LATERAL (SELECT unnest(generate_series(r.x + 1, r.b)) AS y) s", _RUNS))
def tm_options(spark, d):
    """The latest call decides the options of the whole rule: the longest matches first, then all again."""
    runs = [[_item("lower", "in", FUNCTION, "one_or_more")]]
    return _search(spark, d, token_matcher.TokenMatcher().add("r", runs, "longest").add("r", [])).select("doc_id", "start", "end")


@query("tm_order", with_tok("SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY rule, CASE WHEN rule = 'b' THEN start - \"end\" ELSE 0 END, start) - 1)::INTEGER AS ord, rule, start, \"end\" FROM (SELECT doc_id, 'a' AS rule, i::INTEGER AS start, (i + 1)::INTEGER AS \"end\" FROM tok WHERE lower(text) IN ('a', 'in') UNION ALL SELECT doc_id, 'b', a::INTEGER, b::INTEGER FROM runs)", _RUNS))
def tm_order(spark, d):
    """Rules with a greedy option come after the others."""
    m = token_matcher.TokenMatcher().add("b", [[_item("lower", "in", FUNCTION, "one_or_more")]], "longest").add("a", [[_LOW("a", "in")]])
    return _found(_search(spark, d, m), "ord")


_UP_TO = "SELECT doc_id, x::INTEGER AS start, y::INTEGER AS \"end\" FROM (SELECT doc_id, b, unnest(generate_series(a, b - 1)) AS x FROM runs) r, LATERAL (SELECT unnest(generate_series(r.x + 1, least(r.b, r.x + 9))) AS y) s"


@query("tm_many_optionals", with_tok(_UP_TO, _RUNS))
def tm_many_optionals(spark, d):
    """Nine items that need not be there: many ways to each match, which is given once."""
    return _search(spark, d, token_matcher.TokenMatcher().add("r", [[_item("lower", "in", FUNCTION, "optional")] * 9])).select("doc_id", "start", "end")


@query("tm_zero_or_more", with_tok("SELECT doc_id, i::INTEGER AS start, y::INTEGER AS \"end\" FROM (SELECT doc_id, i, b FROM tok JOIN runs USING (doc_id) WHERE lower(text) = 'of' AND i >= a AND i < b) r, LATERAL (SELECT unnest(generate_series(r.i + 1, r.b)) AS y) s", _RUNS))
def tm_zero_or_more(spark, d):
    return _search(spark, d, token_matcher.TokenMatcher().add("r", [[_LOW("of"), _item("lower", "in", FUNCTION, "zero_or_more")]])).select("doc_id", "start", "end")


@query("tm_first_values", with_tok(f"{_SPAN.format(chr(39) + 'text' + chr(39), 'i', 'i + 2')} nx WHERE text = 'The' AND length(t1) > 3 UNION ALL {_SPAN.format(chr(39) + 'lower' + chr(39), 'i', 'i + 2')} nx WHERE lower(text) = 'the' AND length(t1) > 3 UNION ALL {_SPAN.format(chr(39) + 'in' + chr(39), 'i', 'i + 2')} nx WHERE lower(text) IN ('of', 'in') AND length(t1) > 3 UNION ALL {_SPAN.format(chr(39) + 'any' + chr(39), 'i', 'i + 2')} nx WHERE length(text) = 2 AND length(t1) > 3", _NEXT))
def tm_first_values(spark, d):
    """Rules that begin at certain values, found by index, and one that begins anywhere."""
    long = _constraint("length", "compare", 3, operator=">")
    firsts = {"text": _item("text", "equals", "The"), "lower": _item("lower", "equals", "the"), "in": _LOW("of", "in"), "any": _constraint("length", "in_integers", [2])}
    return _found(_search(spark, d, token_matcher.TokenMatcher().add_all([(n, [[f, long]]) for n, f in firsts.items()])))


# ---- phrases -------------------------------------------------------------------------------------------------------


def _phrases_found(spark, d, m: phrase_matcher.PhraseMatcher, errors: bool = False) -> DataFrame:
    return m.find(model_docs(spark, d, lambda *_: None), errors)


def _phrase_doc(words: list[str]) -> dict:
    tokens, at = [], 0
    for w in words:
        tokens.append({"start": at, "end": at + len(w.encode()), "norm": w.lower(), **dict.fromkeys(("tag", "pos", "morphology", "lemma", "dep"))})
        at += len(w.encode())
    return {"text": "".join(words), "tokens": tokens}


@query("pm_registry", with_tok(f"{_SPAN.format(chr(39) + 'x' + chr(39), 'i', 'i + 2')} nx WHERE lower(text) IN ('of', 'in') AND lower(t1) = 'the' UNION ALL {_SPAN.format(chr(39) + 'z' + chr(39), 'i', 'i + 1')} nx WHERE lower(text) = 'to'", _NEXT))
def pm_registry(spark, d):
    """Phrases given as documents, twice and empty ones too; a rule that is removed."""
    m = phrase_matcher.PhraseMatcher("lower").add_docs("x", [_phrase_doc(["of", "the"]), _phrase_doc(["In", "The"]), _phrase_doc(["of", "the"]), _phrase_doc([])])
    m = m.add("y", [["and"]]).add("z", [["to"]]).remove("y")
    assert len(m) == 2 and "y" not in m and m.get("x") == (("of", "the"), ("in", "the"))
    return _found(_phrases_found(spark, d, m))


#: Names whose hashes leave the remainders 7, 3 and 2 modulo 8, the first table size.
_NAMES = ("a", "b", "d")


@query("pm_order", with_tok("SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, size, id % 8) - 1)::INTEGER AS ord, rule, i::INTEGER AS start, (i + size)::INTEGER AS \"end\" FROM (SELECT doc_id, i, rule, id, size FROM nx JOIN names ON lower(nx.text) = 'of' AND (size = 1 OR lower(t1) = 'the'))",
    f"{_NEXT}, nm AS (SELECT unnest(['a', 'b', 'd']) AS text), {hash_sql('nm')}, names AS (SELECT text AS rule, id, size FROM ids, (SELECT unnest([1, 2]) AS size))"))
def pm_order(spark, d):
    """Matches by start, then end, then the place of the rule's id in a table of eight cells."""
    m = phrase_matcher.PhraseMatcher("lower")
    for n in _NAMES:
        m = m.add(n, [["of"], ["of", "the"]])
    return _found(_phrases_found(spark, d, m), "ord")


def _morph_of_some(k, tokens, doc) -> None:
    for t in tokens:
        t["morphology"] = ("Case=Nom", "", "x")[k % 3]


@query("pm_morph_check", with_tok("SELECT doc_id, i::INTEGER AS start, NULL::VARCHAR AS error FROM tok WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, NULL, 'unsupported' FROM nn WHERE doc_id % 3 = 2", _N))
def pm_morph_check(spark, d):
    """Phrases over morphology need canonical documents; an empty analysis is the key "_"."""
    m = phrase_matcher.PhraseMatcher("morphology").add("r", [["Case=Nom"]])
    return m.find(model_docs(spark, d, _morph_of_some), errors=True).select("doc_id", "start", "error")


# ---- dependency patterns -------------------------------------------------------------------------------------------

_node = lambda i, cs=(), left=None, rel=None: {"id": i, "constraints": list(cs), "link": {"left": left, "relation": rel} if left else None}
_low = lambda *v: [{"attribute": "lower", "predicate": {"kind": "in", "values": list(v)}}]
_DEPS = [
    ("one node", [_node("a")], "ok"), ("no node", [], "pattern"), ("two links", [_node("a"), _node("b", (), "a", ">"), _node("c", (), "b", "<")], "ok"), ("a first link", [_node("a", (), "a", ">")], "pattern"), ("no link", [_node("a"), _node("b")], "pattern"),
    ("one id twice", [_node("a"), _node("a", (), "a", ">")], "pattern"), ("a later node", [_node("a"), _node("b", (), "c", ">"), _node("c", (), "a", ">")], "pattern"), ("an unknown relation", [_node("a"), _node("b", (), "a", "><")], "pattern"), ("a named relation", [_node("a"), _node("b", (), "a", "child")], "ok"),
]


@query("dep_compile", _values([(n, e) for n, _, e in _DEPS], "name, outcome"))
def dep_compile(spark, d):
    rows = spark.createDataFrame([(n, json.dumps(s)) for n, s, _ in _DEPS], "name string, spec string")
    return per_document(rows, lambda r: [{"name": r["name"], "outcome": _outcome(lambda: dependency_matcher.pattern_of(json.loads(r["spec"])))}], "name string, outcome string")


def _heap_heads(k, tokens, doc) -> None:
    for i, t in enumerate(tokens):
        t["head"] = i - i % WINDOW + max(0, (i % WINDOW - 1) // 2)


@query("dep_order", with_tok(
    "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k, root, t0, t1) - 1)::INTEGER AS ord, rule, t0::INTEGER AS t0, t1::INTEGER AS t1 FROM (SELECT A.doc_id, 0 AS k, 'up' AS rule, A.root, A.i AS t0, A.head AS t1 FROM t A WHERE lower(A.text) IN ('the', 'of') AND A.i <> A.head"
    " UNION ALL SELECT A.doc_id, 1, 'next', A.root, A.i, B.i FROM t A JOIN t B ON B.doc_id = A.doc_id AND B.root = A.root AND B.i = A.i + 1 WHERE lower(A.text) = 'in')", _HEAP))  # fmt: skip
def dep_order(spark, d):
    """Matches by rule, pattern, tree and tokens; a third rule comes and goes."""
    m = dependency_matcher.DependencyMatcher().add("up", [[_node("a", _low("the", "of")), _node("b", (), "a", "<")]]).add("none", [[_node("a")]])
    m = m.add("next", [[_node("a", _low("in")), _node("b", (), "a", ".")]]).remove("none")
    assert len(m) == 2 and "none" not in m and m.get("up") is not None
    return m.find(model_docs(spark, d, _heap_heads)).select("doc_id", "ord", "rule", F.col("tokens")[0].alias("t0"), F.col("tokens")[1].alias("t1"))


def _faulty_heads(k, tokens, doc) -> None:
    _heap_heads(k, tokens, doc)
    if tokens and k % 4:
        if k % 4 == 3:
            tokens[-1]["head"] = 0  # the first token closes a circle with the last one
            tokens[0]["head"] = len(tokens) - 1
        else:
            tokens[-1]["head"] = (None, len(tokens))[k % 4 - 1]


@query("dep_heads", with_tok("SELECT doc_id, CASE WHEN doc_id % 4 = 0 OR doc_id % 4 = 3 AND n = 1 THEN NULL WHEN doc_id % 4 = 1 THEN 'missing_head at token ' || (n - 1) WHEN doc_id % 4 = 2 THEN 'head_out_of_bounds at token ' || (n - 1) ELSE 'cycle at token 0' END AS fault FROM nn", _N))
def dep_heads(spark, d):
    """The first fault of a document's heads: a missing one, one out of bounds, a cycle."""
    m = dependency_matcher.DependencyMatcher().add("r", [[_node("a")]])
    return m.find(model_docs(spark, d, _faulty_heads), errors=True).groupBy("doc_id").agg(F.max("message").alias("fault"))


# ---- entities, groups, rulers --------------------------------------------------------------------------------------


def _with_ids(batch: batches.Batch) -> None:
    i, n = batch.places, len(batch.places)
    constant = lambda v: pa.repeat(pa.scalar(v, pa.string()), n)
    ids = pa.array(["id0", "id1", "id2"]).take(pa.array(i % 3, mask=i % 2 == 0))
    batch.fields |= {"entity_iob": constant("B"), "entity_type": constant("OLD"), "entity_id": ids}


def _updated(spark, d, fill, update: str, errors: bool = False) -> DataFrame:
    span = "array<struct<start:int,end:int,label:string,id:string>>"
    kind = f"struct<entities:{span},blocked:{span},missing:{span},outside:{span},default:string>"
    words = _docs_for_search(spark, d).where("size(words) >= 6").withColumn("update", F.from_json(F.lit(update), kind))
    return entities.update_entities(batches.words_as_docs(words, fill), errors=errors)


_TAGS = "entity_iob string, entity_type string, entity_id string"
_SIX = "six AS (SELECT doc_id, i, CASE WHEN i % 2 = 1 THEN 'id' || (i % 3) END AS id FROM tok JOIN nn USING (doc_id) WHERE n >= 6)"


@query("ent_ids", with_tok(
    "SELECT doc_id, i::INTEGER AS i, CASE WHEN i = 1 OR i = 3 OR i = 5 THEN 'B' WHEN i = 2 THEN 'I' WHEN i = 4 THEN '' ELSE 'O' END AS iob, CASE WHEN i IN (1, 2) THEN 'NEW' WHEN i = 3 THEN 'KEEP' WHEN i = 4 THEN NULL ELSE '' END AS kind, CASE WHEN i IN (1, 2) THEN 'n' ELSE id END AS id FROM six", f"{_N}, {_SIX}"))
def ent_ids(spark, d):
    """Ids stay but where an entity brings its own; tokens outside have an empty type, missing ones have none."""
    update = {"entities": [{"start": 1, "end": 3, "label": "NEW", "id": "n"}, {"start": 3, "end": 4, "label": "KEEP"}, {"start": 0, "end": 6, "label": ""}], "missing": [{"start": 4, "end": 5}], "blocked": [{"start": 5, "end": 6}], "default": "outside"}
    t = batches.tokens_only(_updated(spark, d, _with_ids, json.dumps(update)), _TAGS)
    return t.select("doc_id", "i", F.coalesce("entity_iob", F.lit("")).alias("iob"), F.col("entity_type").alias("kind"), F.col("entity_id").alias("id"))


@query("ent_unmodified", with_tok("SELECT doc_id, i::INTEGER AS i, CASE WHEN i IN (1, 2) THEN 'O' ELSE 'B' END AS iob, CASE WHEN i IN (1, 2) THEN '' ELSE 'OLD' END AS kind, id FROM six", f"{_N}, {_SIX}"))
def ent_unmodified(spark, d):
    t = batches.tokens_only(_updated(spark, d, _with_ids, json.dumps({"outside": [{"start": 1, "end": 3}], "default": "unmodified"})), _TAGS)
    return t.select("doc_id", "i", F.col("entity_iob").alias("iob"), F.col("entity_type").alias("kind"), F.col("entity_id").alias("id"))


@query("ent_bounds", with_tok("SELECT doc_id, CASE WHEN n < 9 THEN 'bounds' END AS error FROM nn WHERE n >= 6", _N))
def ent_bounds(spark, d):
    """A span past the end is an error, even of an entity without a label, which writes nothing."""
    docs = _updated(spark, d, _with_ids, json.dumps({"entities": [{"start": 7, "end": 9, "label": ""}], "default": "missing"}), errors=True)
    return batches.only(docs, "doc_id bigint, error string")


@query("ent_overlap", with_tok("SELECT doc_id, 'bounds' AS error FROM nn WHERE n >= 6", _N))
def ent_overlap(spark, d):
    docs = _updated(spark, d, _with_ids, json.dumps({"entities": [{"start": 1, "end": 3, "label": "A"}], "blocked": [{"start": 2, "end": 4}], "default": "missing"}), errors=True)
    return batches.only(docs, "doc_id bigint, error string")


@query("ent_annotated", with_tok("SELECT doc_id, NULL::INTEGER AS entities FROM nn WHERE n >= 6", _N))
def ent_annotated(spark, d):
    """Where every tag is missing there are no entities, rather than none of them."""
    docs = _updated(spark, d, _with_ids, json.dumps({"default": "missing"}))
    return docs.select("doc_id", F.when(F.col("entities").isNotNull(), F.size("entities")).alias("entities"))


def _group_kernel(spark, d, f, ddl: str) -> DataFrame:
    return per_document(docs_of(spark, d).select("doc_id"), f, ddl)


@query("group_concat", "SELECT doc_id, 2 + doc_id % 3 AS spans, (5 * (2 + doc_id % 3))::BIGINT AS ends, 'a=1,b=' || CASE WHEN doc_id % 2 = 0 THEN '2' ELSE '3' END AS attrs FROM documents")
def group_concat(spark, d):
    """A group with another one's spans, and those of its attributes that it lacks."""

    def run(row: dict) -> list[dict]:
        k = row["doc_id"]
        span = {"start": 0, "end": 5, "label": "", "id": None}
        one = entities.set_group([], "x", [span] * 2, 9, attrs=[("a", "1")] + ([("b", "2")] if k % 2 == 0 else []))[0]
        two = entities.set_group([], "y", [span] * (k % 3), 9, attrs=[("a", "9"), ("b", "3")])[0]
        g = entities.concat_groups(one, two)
        return [{"doc_id": k, "spans": len(g["spans"]), "ends": sum(s["end"] for s in g["spans"]), "attrs": ",".join(f"{a['key']}={a['json']}" for a in g["attrs"])}]

    return _group_kernel(spark, d, run, "doc_id bigint, spans bigint, ends bigint, attrs string")


@query("group_attrs", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'json' ELSE 'ok' END AS outcome, CASE WHEN doc_id % 3 = 0 THEN 'bounds' ELSE 'ok' END AS spans FROM documents")
def group_attrs(spark, d):
    """A group's attributes have keys of their own, and its spans lie in the text."""

    def run(row: dict) -> list[dict]:
        k = row["doc_id"]
        attrs = lambda: entities.set_group([], "x", [], 3, attrs=[("a", "1"), ("a" if k % 2 == 0 else "b", "1")])
        spans = lambda: entities.set_group([], "x", [{"start": 1, "end": 4 if k % 3 == 0 else 3}], 3)
        return [{"doc_id": k, "outcome": _outcome(attrs), "spans": _outcome(spans)}]

    return _group_kernel(spark, d, run, "doc_id bigint, outcome string, spans string")


_FUNC = {"label": "FUNC", "pattern": [_LOW(*FUNCTION)]}
_PAIR = {"label": "PAIR", "pattern": [_LOW("of"), _LOW("the")], "id": "of-the"}
_FUNC_SQL = f"fn AS (SELECT doc_id, i FROM tok WHERE lower(text) IN ({_IN(FUNCTION)}))"


def _old_entities(batch: batches.Batch) -> None:
    """Every fifth token is an entity."""
    i, n = batch.places, len(batch.sizes)
    fifth = np.flatnonzero(i % 5 == 0)
    iob, kind = (pa.array(v).take(pa.array((i % 5 > 0).astype(np.int8))) for v in (["B", "O"], ["OLD", ""]))
    batch.fields |= {"entity_iob": iob, "entity_type": kind}
    batch.columns["entities"] = batches.spans_of(batch.doc[fifth], n, i[fifth], i[fifth] + 1, pa.repeat(pa.scalar("OLD"), len(fifth)), pa.nulls(len(fifth), pa.string()))


def _with_old(spark, d) -> DataFrame:
    return batches.words_as_docs(_docs_for_search(spark, d), _old_entities)


def _entity_rows(docs: DataFrame) -> DataFrame:
    return batches.only(docs, f"doc_id bigint, entities {DOC['entities']}").select("doc_id", F.explode("entities").alias("s")).select("doc_id", "s.label", "s.start", "s.end")


@query("er_keeps_entities", with_tok(f"{_ROW}(SELECT doc_id, 'OLD' AS label, i AS a, i + 1 AS b FROM tok WHERE i % 5 = 0 UNION ALL SELECT doc_id, 'FUNC', i, i + 1 FROM fn WHERE i % 5 <> 0)", _FUNC_SQL))
def er_keeps_entities(spark, d):
    """Matches that touch an entity are left out."""
    return _entity_rows(rulers.EntityRuler().add([_FUNC]).annotate(_with_old(spark, d)))


@query("er_overwrites", with_tok(f"{_ROW}(SELECT doc_id, 'FUNC' AS label, i AS a, i + 1 AS b FROM fn UNION ALL SELECT doc_id, 'OLD', i, i + 1 FROM tok WHERE i % 5 = 0 AND lower(text) NOT IN ({_IN(FUNCTION)}))", _FUNC_SQL))
def er_overwrites(spark, d):
    """Entities that a match touches give way."""
    return _entity_rows(rulers.EntityRuler(overwrite_entities=True).add([_FUNC]).annotate(_with_old(spark, d)))


@query("er_registry", with_tok(f"{_ROW}(SELECT doc_id, 'FUNC' AS label, i AS a, i + 1 AS b FROM fn UNION ALL SELECT doc_id, 'PHRASE', i, i + 2 FROM nx WHERE text = 'in' AND t1 = 'the')", f"{_NEXT}, {_FUNC_SQL}"))
def er_registry(spark, d):
    """Token patterns and phrases; what is removed by its id no longer matches."""
    r = rulers.EntityRuler().add([_FUNC, _PAIR, {"label": "PHRASE", "pattern": ["in", "the"], "id": "p"}])
    assert r.labels() == ["FUNC", "PAIR", "PHRASE"] and r.ids() == ["of-the", "p"] and len(r) == 3 and len(r.clear()) == 0
    return r.remove("of-the").find(model_docs(spark, d, lambda *_: None)).select("doc_id", "label", "start", "end")


@query("ruler_labels", _values([("entity", "labels", "A,B"), ("entity", "ids", "x,y"), ("span", "labels", "A,B,C"), ("span", "ids", "x")], "ruler, what, names"))
def ruler_labels(spark, d):
    """Labels and ids, sorted; a span ruler knows its labels after their rules are gone."""
    rule = lambda label, i: {"label": label, "pattern": [_LOW("the")], "id": i}
    e, s = rulers.EntityRuler().add([rule("B", "y"), rule("A", "x"), rule("A", "")]), rulers.SpanRuler().add([rule("B", "y"), rule("A", "x"), rule("C", "")]).remove("C").remove_by_id("y")
    rows = [(k, what, ",".join(getattr(x, what)())) for k, x in (("entity", e), ("span", s)) for what in ("labels", "ids")]
    return spark.createDataFrame(rows, "ruler string, what string, names string")


def _held_group(k, tokens, doc) -> None:
    if tokens:
        doc["span_groups"] = entities.set_group([], "ruler", [{"start": 0, "end": 1, "label": "HELD"}], len(tokens))


def _group_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode(F.flatten(F.transform("span_groups", lambda g: g["spans"]))).alias("s")).select("doc_id", "s.label", "s.start", "s.end")


@query("sr_extends", with_tok(f"{_ROW}(SELECT doc_id, 'HELD' AS label, 0 AS a, 1 AS b FROM nn, (SELECT unnest([1, 2])) UNION ALL SELECT doc_id, 'FUNC', i, i + 1 FROM fn WHERE i > 0)", f"{_N}, {_FUNC_SQL}"))
def sr_extends(spark, d):
    """A group that is extended through a filter has the spans that the filter keeps twice."""
    return _group_rows(rulers.SpanRuler(overwrite=False, spans_filter="prioritize_existing").add([_FUNC]).annotate(model_docs(spark, d, _held_group)))


@query("sr_replaces", with_tok(f"{_ROW}(SELECT doc_id, 'FUNC' AS label, i AS a, i + 1 AS b FROM fn)", _FUNC_SQL))
def sr_replaces(spark, d):
    return _group_rows(rulers.SpanRuler().add([_FUNC, {"label": "GONE", "pattern": [_LOW("the")]}]).remove("GONE").annotate(model_docs(spark, d, _held_group)))


@query("sr_entities", with_tok(f"{_ROW}(SELECT doc_id, 'FUNC' AS label, i AS a, i + 1 AS b FROM fn UNION ALL SELECT doc_id, 'OLD', i, i + 1 FROM tok WHERE i % 5 = 0 AND lower(text) NOT IN ({_IN(FUNCTION)}))", _FUNC_SQL))
def sr_entities(spark, d):
    """New spans become entities, before those that were there."""
    r = rulers.SpanRuler(spans_key=None, annotate_entities=True, entities_filter="prioritize_new", overwrite=False).add([_FUNC])
    return _entity_rows(r.annotate(_with_old(spark, d)))


_FILTER_SQL = (
    f"{_NEXT}, fn AS (SELECT doc_id, i, i AS a, i + 1 AS b, 'FUNC' AS label FROM tok WHERE lower(text) IN ({_IN(FUNCTION)})), pr AS (SELECT doc_id, i, i AS a, i + 2 AS b, 'PAIR' AS label FROM nx WHERE lower(text) = 'of' AND lower(t1) = 'the'),"
    " old AS (SELECT doc_id, i, i AS a, i + 1 AS b, 'OLD' AS label FROM tok WHERE i % 6 = 0), inpair AS (SELECT doc_id, a AS i FROM pr UNION SELECT doc_id, a + 1 FROM pr), hit AS (SELECT doc_id, i FROM fn UNION SELECT doc_id, i FROM inpair)"
)
_FILTERED = {
    # The longest first; of one length and start what was there comes first.
    "first_longest": "SELECT * FROM pr UNION ALL SELECT * FROM old WHERE (doc_id, i) NOT IN (SELECT doc_id, i FROM inpair) UNION ALL SELECT * FROM fn WHERE i % 6 <> 0 AND (doc_id, i) NOT IN (SELECT doc_id, i FROM inpair)",
    "prioritize_new": "SELECT * FROM pr UNION ALL SELECT * FROM fn WHERE (doc_id, i) NOT IN (SELECT doc_id, i FROM inpair) UNION ALL SELECT * FROM old WHERE (doc_id, i) NOT IN (SELECT doc_id, i FROM hit)",
    "prioritize_existing": "SELECT * FROM old UNION ALL SELECT * FROM pr WHERE i % 6 NOT IN (0, 5) UNION ALL SELECT * FROM fn WHERE i % 6 <> 0 AND (doc_id, i) NOT IN (SELECT doc_id, a FROM pr WHERE i % 6 NOT IN (0, 5) UNION SELECT doc_id, a + 1 FROM pr WHERE i % 6 NOT IN (0, 5))",
}


def _filter(name: str, source: str) -> None:
    def run(spark, d):
        def one(k, words):
            low = [w.lower() for w in words]
            span = lambda a, b, label: {"start": a, "end": b, "label": label, "id": None}
            old = [span(i, i + 1, "OLD") for i in range(0, len(low), 6)]
            new = [span(i, i + 1, "FUNC") for i, w in enumerate(low) if w in FUNCTION] + [span(i, i + 2, "PAIR") for i in range(len(low) - 1) if low[i] == "of" and low[i + 1] == "the"]
            return [{"doc_id": k, **{c: s[c] for c in ("label", "start", "end")}} for s in entities.FILTERS[name](old, new, len(low))]

        return _kernel(spark, d, one, "doc_id bigint, label string, start int, end int")

    query(f"filter_{name}", with_tok(f"{_ROW}({source})", _FILTER_SQL))(run)


for _name, _source in _FILTERED.items():
    _filter(_name, _source)


# ---- trees, sentences, annotators ----------------------------------------------------------------------------------


def _sentences_of_some(spark, d) -> DataFrame:
    """Documents with heads; of three one has sentences of 31 tokens, one has none, one lacks those of its last tokens."""
    docs = heap_docs(spark, d)
    size = F.size("tokens")
    every = F.transform(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(WINDOW)), lambda a: F.struct(a.alias("start"), F.least(a + WINDOW, size).alias("end"), F.lit("").alias("label"), F.lit(None).cast("string").alias("id")))
    kept = F.when(F.col("doc_id") % 3 == 0, every).when(F.col("doc_id") % 3 == 2, F.slice(every, F.lit(1), F.greatest(F.size(every) - 1, F.lit(0))))
    return docs.where(size > 0).withColumn("sentences", kept.cast(DOC["sentences"]))


@query("trav_sentence_of", with_tok("SELECT doc_id, i::INTEGER AS i, CASE WHEN doc_id % 3 = 0 THEN root::INTEGER END AS start, CASE WHEN doc_id % 3 = 0 THEN least(root + 31, n)::INTEGER END AS \"end\", NULL::VARCHAR AS error FROM t JOIN nn USING (doc_id) WHERE doc_id % 3 < 2 UNION ALL SELECT doc_id, NULL, NULL, NULL, 'invalid_sentence' FROM nn WHERE doc_id % 3 = 2", f"{_HEAP}, {_N}"))
def trav_sentence_of(spark, d):
    """The sentence of every token; none where there are no sentences, an error where a token is in none of them."""
    t = trees.traversal(_sentences_of_some(spark, d), errors=True)
    return t.select("doc_id", "i", F.col("sentence_start").alias("start"), F.col("sentence_end").alias("end"), "error")


def _preorder(k: int = 0) -> list[int]:
    return [k, *_preorder(2 * k + 1), *_preorder(2 * k + 2)] if k < WINDOW else []


@query("trav_subtree_order", with_tok(f"SELECT doc_id, sum(p * i)::BIGINT AS digest FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, root ORDER BY list_position([{', '.join(map(str, _preorder()))}], (i - root)::INTEGER)) AS p FROM t) GROUP BY doc_id", _HEAP))
def trav_subtree_order(spark, d):
    """The order of the subtrees of all roots: left of a token what hangs there, then itself, then what hangs to its right."""

    def run(row: dict) -> list[dict]:
        heads = [t["head"] for t in row["tokens"] or []]
        kids = trees.children_of(heads)
        total = sum(p * t for r, h in enumerate(heads) if h == r for p, t in enumerate(trees.subtree(heads, r, kids), 1))
        return [{"doc_id": row["doc_id"], "digest": total}] if heads else []

    return per_document(heap_docs(spark, d), run, "doc_id bigint, digest bigint")


@query("sentence_views", with_tok("SELECT doc_id, root::INTEGER AS start, (max(i) + 1)::INTEGER AS \"end\", min(CASE WHEN i = root THEN text END) AS first, count(*) AS starts FROM t GROUP BY doc_id, root", _HEAP))
def sentence_views(spark, d):
    """Sentences from the trees, with the text of their first token and the tokens in them."""
    docs = annotators.segment(model_docs(spark, d, _heap_heads))
    s = docs.select("doc_id", "text", "tokens", F.explode("sentences").alias("s"))
    first = F.get(F.col("tokens"), F.col("s.start"))
    text = F.decode(F.substring(F.encode("text", "utf-8"), first["start"] + 1, first["end"] - first["start"]), "utf-8")
    return s.select("doc_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), text.alias("first"), (F.col("s.end") - F.col("s.start")).cast("long").alias("starts"))


_CHUNK_TAGS = "nt AS (SELECT doc_id, i, head, CASE WHEN i % 5 IN (2, 4) THEN true ELSE false END AS noun, CASE i % 5 WHEN 2 THEN 'conj' WHEN 3 THEN 'x' WHEN 4 THEN 'dobj' ELSE 'det' END AS dep FROM rt)"
_CHUNK_BASE = f"{_RIGHT_HEADS}, {_CHUNK_TAGS}, hd AS (SELECT a.*, b.dep AS up FROM nt a JOIN nt b ON b.doc_id = a.doc_id AND b.i = a.head)"


@query("noun_chunks", with_tok("SELECT doc_id, (i - 2)::INTEGER AS start, (i + 1)::INTEGER AS \"end\" FROM hd WHERE i % 5 = 2 AND up = 'dobj'", _CHUNK_BASE))
def noun_chunks(spark, d):
    """Windows of five: the third is a conjunct of the fifth, which stands to its right and begins inside the third's chunk."""

    def run(row: dict) -> list[dict]:
        tokens = [{"head": t["head"], "pos": "NOUN" if i % 5 in (2, 4) else "X", "dep": ("det", "det", "conj", "x", "dobj")[i % 5]} for i, t in enumerate(row["tokens"] or [])]
        return [{"doc_id": row["doc_id"], "start": s["start"], "end": s["end"]} for s in annotators.noun_chunks_of(tokens)]

    return per_document(right_docs(spark, d), run, "doc_id bigint, start int, end int")


_TABLES = annotators.LemmaTables(index={"noun": frozenset(_INDEX)}, rules={"noun": (("ies", "y"), ("s", ""), ("ing", ""))}, exceptions={"noun": {"the": ("thou", "thee")}})
_FORMS = [("ies", "y"), ("s", ""), ("ing", "")]
_FORM_SQL = ", ".join(f"CASE WHEN ends_with(low, '{a}') AND length(low) > {0 if b else len(a)} THEN left(low, length(low) - {len(a)}) || '{b}' END AS f{k}" for k, (a, b) in enumerate(_FORMS))
_KNOWN = ", ".join(f"CASE WHEN f{k} IN ({_IN(_INDEX)}) THEN f{k} END" for k in (2, 1, 0))
_ODD = ", ".join(f"CASE WHEN f{k} NOT IN ({_IN(_INDEX)}) AND NOT regexp_full_match(f{k}, '\\p{{L}}+') THEN f{k} END" for k in range(3))
_PLAIN = ", ".join(f"CASE WHEN f{k} NOT IN ({_IN(_INDEX)}) AND regexp_full_match(f{k}, '\\p{{L}}+') THEN f{k} END" for k in range(3))
_LEMMA_SQL = with_tok(f"SELECT text, CASE WHEN low = 'the' THEN 'thee' ELSE coalesce({_KNOWN}, {_ODD}, {_PLAIN}, text) END AS value FROM (SELECT text, low, {_FORM_SQL} FROM (SELECT DISTINCT text, lower(text) AS low FROM tok))")
query("lemma_rules", _LEMMA_SQL)(lambda spark, d: _numbered(_words(spark, d), lambda t: annotators.lemma(t, "NOUN", None, _TABLES)))
query("lemma_toy", _LEMMA_SQL)(lambda spark, d: _words(spark, d).select("text", annotators.lemma_column(F.col("text"), "noun", _TABLES).alias("value")))


@query("lemma_base_forms", with_tok("SELECT DISTINCT text, 'plural' AS form, CASE WHEN lower(text) LIKE '%s' AND length(text) > 1 THEN left(lower(text), length(text) - 1) ELSE text END AS value FROM tok WHERE length(lower(text)) = length(text) UNION SELECT DISTINCT text, 'singular', lower(text) FROM tok WHERE length(lower(text)) = length(text) UNION SELECT DISTINCT text, 'name', text FROM tok WHERE length(lower(text)) = length(text)"))
def lemma_base_forms(spark, d):
    """What the analysis says is a base form stays; names without tables keep their case."""
    tables = annotators.LemmaTables(rules={"noun": (("s", ""),)})
    forms = (("plural", "NOUN", "Number=Plur"), ("singular", "NOUN", "Number=Sing"), ("name", "PROPN", None))
    run = lambda r: [{"text": r["text"], "form": f, "value": annotators.lemma(r["text"], pos, m, tables)} for f, pos, m in forms]
    return per_document(_words(spark, d).where(F.length(F.lower("text")) == F.length("text")), run, "text string, form string, value string")


_EXCEPTION_TEXT = "concat(CASE WHEN doc_id % 2 = 0 THEN 'can''t ' ELSE '(can''t) ' END, 'go, ', doc_id::VARCHAR, '-x')"


@query("tokenize_exceptions", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'ca|n''t|' ELSE '(|ca|n''t|)|' END || 'go|,|' || doc_id::VARCHAR || '-x' AS tokens FROM documents")
def tokenize_exceptions(spark, d):
    """Prefixes, suffixes and exceptions of the rule tokenizer on sentences made of ids."""
    text = F.concat(F.when(F.col("doc_id") % 2 == 0, "can't ").otherwise("(can't) "), F.lit("go, "), F.col("doc_id").cast("string"), F.lit("-x"))
    docs = tokenize(docs_of(spark, d).select("doc_id", text.alias("text")), TokenizerRules(exceptions={"can't": (("ca", None), ("n't", "not"))}))
    return docs.select("doc_id", F.array_join(F.transform("tokens", lambda t: F.decode(F.substring(F.encode("text", "utf-8"), t["start"] + 1, t["end"] - t["start"]), "utf-8")), "|").alias("tokens"))


@query("too_long", "SELECT doc_id, length(text)::INTEGER AS length FROM documents WHERE length(text) > 2000")
def too_long(spark, d):
    """Documents above a limit in characters."""
    return snapshot.too_long(docs_of(spark, d), 2000)


@query("vec_words", "SELECT word, round(embedding[1]::DOUBLE, 6) AS x, round(embedding[2]::DOUBLE, 6) AS y FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '\\p{L}+')) AS word FROM benchmark) JOIN embeddings ON vec_id = length(word) * 2")
def vec_words(spark, d):
    """The static vector of every word of the benchmark that has one; vectors stand for words by their length here."""
    words = spark.read.parquet(f"{d}/benchmark.parquet").select(F.explode(F.regexp_extract_all("text", F.lit("\\p{L}+"), F.lit(0))).alias("word")).distinct()
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    table = words.join(e, e["vec_id"] == F.length("word") * 2).select(F.col("word").alias("key"), F.col("embedding").alias("vec"))
    v = vectors.token_vectors(words.withColumnRenamed("word", "text"), table).where("vector is not null")
    return v.select(F.col("text").alias("word"), F.round(F.get("vector", F.lit(0)).cast("double"), 6).alias("x"), F.round(F.get("vector", F.lit(1)).cast("double"), 6).alias("y"))


_ORDERS = [("tok2vec,tagger,parser,attribute_ruler,lemmatizer", "ok"), ("tagger", "unsupported"), ("tok2vec,tagger,attribute_ruler", "unsupported"), ("ner", "ok"), ("tok2vec,tok2vec", "unsupported"), ("tok2vec,tagger,parser,lemmatizer", "unsupported"), ("sentencizer", "unsupported")]


@query("pipeline_order", _values(_ORDERS, "components, outcome"))
def pipeline_order(spark, d):
    rows = spark.createDataFrame([(c,) for c, _ in _ORDERS], "components string")
    return per_document(rows, lambda r: [{"components": r["components"], "outcome": _outcome(lambda: pipeline.check_order(r["components"].split(",")))}], "components string, outcome string")


_SIZES = [('{"nlp": {"batch_size": 7}}', "7"), ("{}", "1000"), ('{"nlp": {"batch_size": 0}}', "unsupported"), ('{"nlp": {"batch_size": true}}', "unsupported"), ('{"nlp": {"batch_size": 2.5}}', "unsupported")]


@query("pipeline_batch_size", _values(_SIZES, "config, size"))
def pipeline_batch_size(spark, d):
    def size(config: str) -> str:
        try:
            return str(pipeline.batch_size(json.loads(config)))
        except EngineError as e:
            return e.code

    return per_document(spark.createDataFrame([(c,) for c, _ in _SIZES], "config string"), lambda r: [{"config": r["config"], "size": size(r["config"])}], "config string, size string")


# ---- models --------------------------------------------------------------------------------------------------------


def sound_manifest() -> dict:
    """A small manifest without faults."""
    empty = {pos: {} for pos in model.LEMMA_POS}
    return {
        "format_version": 2, "model": "toy", "model_version": "1", "capabilities": {"language": "en"}, "pipeline": ["tok2vec", "tagger", "parser", "ner"], "attribute_rules": [],
        "tokenizer": {"regex_dialect": model.DIALECT, "rules": {"can't": [{"orth": "ca"}, {"orth": "n't", "norm": "not"}], "New York": [{"orth": "New"}, {"orth": "York"}]}},
        "lexical": {"ranges": {"alpha": [[65, 90], [97, 122]]}}, "lemmas": {"lemma_index": empty, "lemma_exc": empty, "lemma_rules": empty},
        "parser": {"actions": [{"kind": "shift", "label": ""}, {"kind": "left", "label": "det"}]}, "ner": {"transition": {"actions": [{"kind": "outside", "label": ""}, {"kind": "unit", "label": "E"}]}},
    }


def _broken(**changes) -> str:
    return json.dumps(sound_manifest() | changes)


_TOKENIZER = lambda **more: {"tokenizer": sound_manifest()["tokenizer"] | more}
_MANIFESTS = [
    ("sound", _broken(), []), ("no version", _broken(format_version=3), ["unsupported"]), ("no capabilities", _broken(capabilities=None), ["unsupported"]), ("no name", _broken(model=" "), ["model"]), ("dialect", _broken(**_TOKENIZER(regex_dialect="other")), ["unsupported"]),
    ("token_match", _broken(**_TOKENIZER(token_match="x")), ["unsupported"]), ("heuristics", _broken(**_TOKENIZER(faster_heuristics=False)), ["unsupported"]), ("exception", _broken(**_TOKENIZER(rules={"a.m": [{"orth": "am"}], "ok": [{"orth": "ok"}], "": []})), ["model", "model"]),
    ("ranges", _broken(lexical={"ranges": {"digit": [[48, 57], [57, 60]], "lower": [[5, 4]]}}), ["model", "model"]), ("attributes", _broken(attribute_rules=[{"patterns": [[{}]], "index": 1, "attrs": {"pos": "NOUNS"}}]), ["model", "model"]), ("lemmas", _broken(lemmas={}), ["model"] * 5),
    ("actions", _broken(parser={"actions": [{"kind": "shift", "label": "x"}, {"kind": "left", "label": ""}, {"kind": "unit", "label": "x"}]}), ["unsupported"] * 3), ("order", _broken(pipeline=["tagger"]), ["unsupported"]), ("json", "{", ["model"]),
    ("legacy", _broken(format_version=1), ["unsupported", "unsupported"]),
]


@query("manifest_check", _values([(n, c, e.count(c)) for n, _, e in _MANIFESTS for c in sorted(set(e))], "name, code, n"))
def manifest_check(spark, d):
    """The faults of manifests given as rows."""
    rows = spark.createDataFrame([(n, m) for n, m, _ in _MANIFESTS], "name string, manifest string")
    return model.check_manifests(rows).groupBy("name", "code").agg(F.count("*").cast("int").alias("n"))
