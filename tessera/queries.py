"""The engine's queries over the driver's tables, each with SQL that gives the same rows where SQL can.

Tokens are those of tokenize_regex. There are no trees, entities or analyses in the tables, so heads, tags and morphology are
synthetic: heads form a binary heap in windows of 31 tokens; tags and analyses follow a token's position.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import lexical, vectors
from .operators import annotators, dependency_matcher, entities, phrase_matcher, rulers, token_matcher, trees
from .operators.tokenizer import REGEX, TokenizerRules, tokenize, tokenize_regex, tokenize_regex_ahead, tokenize_regex_docs
from .plans.predicates import Constraint, column_of
from .schema import DOC, assemble_docs, explode_tokens
from .session import shared_dir
from .sources import snapshot
from .streaming.annotate import annotate_stream, read_documents

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

WINDOW = 31
WORDS_SQL = f"(SELECT doc_id, regexp_extract_all(text, '{REGEX}') AS w FROM documents)"
TOK = f"tok AS (SELECT doc_id, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS text FROM {WORDS_SQL})"
_IN = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def docs_of(spark: SparkSession, d: str) -> DataFrame:
    """Ids and texts; a scan with fewer partitions than cores is dealt out, a larger one is left as it is."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def tok(spark: SparkSession, d: str) -> DataFrame:
    return tokenize_regex(docs_of(spark, d))


def tok_ahead(spark: SparkSession, d: str, ahead: int) -> DataFrame:
    return tokenize_regex_ahead(docs_of(spark, d), ahead)


def keyed(spark: SparkSession, d: str, key: Callable[[F.Column], F.Column], ahead: int) -> tuple[DataFrame, list[str]]:
    """The token table with a key for each token and for those ahead of it, and the names of the latter."""
    t = tok_ahead(spark, d, ahead)
    names = [f"key{k}" for k in range(1, ahead + 1)]
    after = [F.when(F.col(f"next{k}").isNotNull(), key(F.col(f"next{k}"))).alias(n) for k, n in enumerate(names, 1)]
    return t.select("doc_id", "i", key(F.col("text")).alias("key"), *after), names


def with_tok(body: str, more: str = "") -> str:
    return f"WITH {TOK}{', ' + more if more else ''} {body}"


# ---- tokens and lexical attributes ---------------------------------------------------------------------------------

query("tokenize_regex", with_tok("SELECT doc_id, i::INTEGER AS i, text FROM tok"))(tok)


@query("tokens_per_doc", with_tok("SELECT doc_id, count(*) AS n, sum(length(text))::BIGINT AS chars FROM tok GROUP BY doc_id"))
def tokens_per_doc(spark, d):
    return tok(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("token_offsets", with_tok("SELECT doc_id, sum(strlen(text))::BIGINT AS bytes, sum(length(text))::BIGINT AS chars, max(length(text))::INTEGER AS longest FROM tok GROUP BY doc_id"))
def token_offsets(spark, d):
    return tok(spark, d).groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).alias("longest"))


def _lexical(name: str, columns: Callable[[F.Column], dict[str, F.Column]], sql_columns: str) -> None:
    def run(spark, d):
        words = tok(spark, d).groupBy("text").agg(F.count("*").alias("n"))
        return words.select("text", "n", *[c.alias(k) for k, c in columns(F.col("text")).items()])

    query(name, with_tok(f"SELECT text, n, {sql_columns} FROM (SELECT text, count(*) AS n FROM tok GROUP BY text)"))(run)


#: A word is title-cased when no capital follows a letter of any case and no small letter anything else: no two cased
#: letters meet but as a capital or small letter before a small one, and there is a capital.
_TITLE_SQL = "(regexp_matches({0}, '[\\p{{Lu}}\\p{{Lt}}]') AND NOT regexp_matches({0}, '[\\p{{Lu}}\\p{{Lt}}\\p{{Ll}}ªº][\\p{{Lu}}\\p{{Lt}}]|(^|[^\\p{{Lu}}\\p{{Lt}}\\p{{Ll}}ªº])[\\p{{Ll}}ªº]'))"
_SHAPE_SQL = "regexp_replace(regexp_replace(regexp_replace(text, '\\p{Lu}', 'X', 'g'), '[\\p{Ll}\\p{Lt}\\p{Lm}\\p{Lo}]', 'x', 'g'), '\\p{Nd}', 'd', 'g')"
for _c in "Xxd":
    _SHAPE_SQL = f"regexp_replace({_SHAPE_SQL}, '{_c}{{5,}}', '{_c * 4}', 'g')"
_lexical("lex_shape", lambda t: {"shape": lexical.shape_col(t)}, f"CASE WHEN length(text) >= 100 THEN 'LONG' ELSE {_SHAPE_SQL} END AS shape")
_lexical("lex_prefix_suffix", lambda t: {"prefix": F.left(t, F.lit(1)), "suffix": F.right(t, F.lit(3))}, "left(text, 1) AS prefix, right(text, 3) AS suffix")
_lexical("lex_lower", lambda t: {"lower": F.lower(t)}, "lower(text) AS lower")
_FLAGS_SQL = (
    "regexp_full_match(text, '\\p{L}+') AS is_alpha, regexp_full_match(text, '[\\x00-\\x7F]+') AS is_ascii, regexp_full_match(text, '\\p{Nd}+') AS is_digit,"
    " regexp_matches(text, '[\\p{Ll}ªº]') AND NOT regexp_matches(text, '[\\p{Lu}\\p{Lt}]') AS is_lower, regexp_matches(text, '\\p{Lu}') AND NOT regexp_matches(text, '[\\p{Ll}\\p{Lt}ªº]') AS is_upper,"
    f" {_TITLE_SQL.format('text')} AS is_title,"
    " regexp_full_match(text, '\\p{P}+') AS is_punct, regexp_full_match(text, '\\s+') AS is_space,"
    " regexp_full_match(text, '\\p{Sc}+') AS is_currency"
)
_lexical(
    "lex_flags",
    lambda t: {k: lexical.flag_col(k, t) for k in ("is_alpha", "is_ascii", "is_digit", "is_lower", "is_upper", "is_title", "is_punct", "is_space", "is_currency")},
    _FLAGS_SQL,
)
_lexical(
    "lex_brackets_quotes",
    lambda t: {k: lexical.flag_col(k, t) for k in ("is_bracket", "is_quote", "is_left_punct", "is_right_punct")},
    f"text IN ({_IN(lexical.BRACKETS)}) AS is_bracket, text IN ({_IN(lexical.QUOTES)}) AS is_quote, text IN ({_IN(lexical.LEFT_PUNCT)}) AS is_left_punct, text IN ({_IN(lexical.RIGHT_PUNCT)}) AS is_right_punct",
)
_BARE = "translate(regexp_replace(text, '^[+\\-±~]', ''), ',.', '')"
_lexical(
    "lex_like_num",
    lambda t: {"like_num": lexical.like_num_col(t)},
    f"regexp_full_match({_BARE}, '[0-9]+') OR regexp_full_match({_BARE}, '[0-9]+/[0-9]+') OR lower({_BARE}) IN ({_IN(lexical.NUMBER_WORDS)}) OR regexp_full_match(lower({_BARE}), '[0-9]+(st|nd|rd|th)') AS like_num",
)
_lexical("lex_is_stop", lambda t: {"is_stop": lexical.flag_col("is_stop", t)}, f"lower(text) IN ({_IN(sorted(lexical.STOP_WORDS))}) AS is_stop")

_CHUNKS = "(SELECT text, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[^ \\n]+')) AS text FROM documents) GROUP BY text)"


def _chunks(spark, d):
    words = F.explode(F.regexp_extract_all(F.col("text"), F.lit("[^ \\n]+"), F.lit(0)))
    return docs_of(spark, d).select(words.alias("text")).groupBy("text").agg(F.count("*").alias("n"))


@query("lex_like_email", f"SELECT text, n FROM {_CHUNKS} WHERE regexp_matches(text, '{lexical.EMAIL_START}')")
def lex_like_email(spark, d):
    return _chunks(spark, d).where(lexical.flag_col("like_email", F.col("text")))


@query("lex_like_url", f"SELECT text, n FROM {_CHUNKS} WHERE regexp_matches(lower(text), '^https?://') OR (starts_with(lower(text), 'www.') AND length(text) > 4) OR (NOT regexp_matches(text, '^[.@]|[.@]$') AND NOT contains(text, '@') AND regexp_matches(text, '{lexical.Lexicon().url}') AND lower(regexp_extract(text, '^(?:[\\w-]+\\.)+([A-Za-z]{{2,63}})', 1)) IN ({_IN(lexical.TLDS)}))")
def lex_like_url(spark, d):
    return _chunks(spark, d).where(lexical.flag_col("like_url", F.col("text")))


# ---- predicates ----------------------------------------------------------------------------------------------------

_MORPHS = (None, "", "Number=Plur", "Case=Acc,Nom|Number=Sing")
ANNOTATED = "ann AS (SELECT doc_id, i, text, CASE i % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE lower(text) END AS lemma, CASE i % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'Number=Plur' ELSE 'Case=Acc,Nom|Number=Sing' END AS morphology FROM tok)"


def annotated(spark, d):
    lemma = F.when(F.col("i") % 3 == 0, F.lit(None)).when(F.col("i") % 3 == 1, F.lit("")).otherwise(F.lower("text"))
    morph = F.when(F.col("i") % 4 == 0, F.lit(None)).when(F.col("i") % 4 == 1, F.lit("")).when(F.col("i") % 4 == 2, F.lit(_MORPHS[2])).otherwise(F.lit(_MORPHS[3]))
    return tok(spark, d).withColumns({"lemma": lemma, "morphology": morph})


def _predicate(name: str, c: Constraint, sql: str, negated: bool = False) -> None:
    def run(spark, d):
        p = column_of(c)
        hits = annotated(spark, d).where(~p if negated else p)
        return hits.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("i").alias("places"))

    where = f"NOT coalesce({sql}, false)" if negated else sql
    query(name, with_tok(f"SELECT doc_id, count(*) AS n, sum(i)::BIGINT AS places FROM ann WHERE {where} GROUP BY doc_id", ANNOTATED))(run)


_predicate("pred_equals", Constraint("lower", "equals", "the"), "lower(text) = 'the'")
_predicate("pred_in", Constraint("lower", "in", ("the", "of", "")), "lower(text) IN ('the', 'of', '')")
_predicate("pred_not_in", Constraint("lemma", "not_in", ("the", "")), "coalesce(lemma, '') NOT IN ('the', '')")
_predicate("pred_subset", Constraint("lemma", "is_subset", ("the", "")), "coalesce(lemma, '') IN ('the', '')")
_predicate("pred_superset", Constraint("lemma", "is_superset", ("the",)), "coalesce(lemma, '') = 'the'")
_predicate("pred_intersects", Constraint("lemma", "intersects", ("of", "a")), "coalesce(lemma, '') IN ('of', 'a')")
_predicate("pred_flag", Constraint("is_title", "flag", True), _TITLE_SQL.format("text"))
_predicate("pred_length_cmp", Constraint("length", "compare", 7.5, ">"), "length(text) > 7.5")
_predicate("pred_length_set", Constraint("length", "in_integers", (2, 3, 5)), "length(text) IN (2, 3, 5)")
_predicate("pred_negated", Constraint("lower", "equals", "the"), "lower(text) = 'the'", negated=True)
_predicate("pred_missing", Constraint("lemma", "equals", ""), "coalesce(lemma, '') = ''")
_predicate("pred_morph_equals_empty", Constraint("morphology", "equals", "_"), "morphology = ''")
_predicate("pred_morph_superset", Constraint("morphology", "is_superset", ("Case=Nom",)), "morphology = 'Case=Acc,Nom|Number=Sing'")
_predicate("pred_morph_subset", Constraint("morphology", "is_subset", ("Number=Plur",)), "coalesce(morphology, '') IN ('', 'Number=Plur')")
_predicate("pred_morph_intersects", Constraint("morphology", "intersects", ("Number=Plur", "Case=Acc")), "morphology IN ('Number=Plur', 'Case=Acc,Nom|Number=Sing')")


# ---- token patterns ------------------------------------------------------------------------------------------------


def _item(attribute: str, kind: str, value, repetition: str = "once", **more) -> dict:
    key = "values" if isinstance(value, list) else "value"
    return {"constraints": [{"attribute": attribute, "predicate": {"kind": kind, key: value}}], "repetition": {"kind": repetition, **more}}


FUNCTION = ["the", "of", "and", "to", "a", "in"]


def _fixed(name: str, items: list, sql: str) -> None:
    def run(spark, d):
        return token_matcher.find_fixed_ahead(tok_ahead(spark, d, len(items) - 1), name, [items]).select("doc_id", "start", "end")

    query(name, sql)(run)


_NEXT = "nx AS (SELECT doc_id, i, text, lead(text, 1) OVER w AS t1, lead(text, 2) OVER w AS t2 FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY i))"
_fixed("tm_fixed2", [_item("lower", "in", FUNCTION), _item("is_title", "flag", True)], with_tok(f"SELECT doc_id, i::INTEGER AS start, (i + 2)::INTEGER AS \"end\" FROM nx WHERE lower(text) IN ({_IN(FUNCTION)}) AND {_TITLE_SQL.format('t1')}", _NEXT))
_fixed(
    "tm_fixed3",
    [_item("lower", "in", FUNCTION), _item("is_alpha", "flag", True), _item("text", "in", [".", ","])],
    with_tok(f"SELECT doc_id, i::INTEGER AS start, (i + 3)::INTEGER AS \"end\" FROM nx WHERE lower(text) IN ({_IN(FUNCTION)}) AND regexp_full_match(t1, '\\p{{L}}+') AND t2 IN ('.', ',')", _NEXT),
)
_fixed(
    "tm_negated",
    [_item("lower", "equals", "the"), _item("is_alpha", "flag", True, "negated")],
    with_tok("SELECT doc_id, i::INTEGER AS start, (i + 2)::INTEGER AS \"end\" FROM nx WHERE lower(text) = 'the' AND NOT regexp_full_match(t1, '\\p{L}+')", _NEXT),
)


def _docs_for_search(spark, d):
    """The kernel's input: the words and nothing else, with their byte offsets worked out in the kernel's own Python."""
    words = F.regexp_extract_all(F.col("text"), F.lit(REGEX), F.lit(0))
    return docs_of(spark, d).select("doc_id", words.alias("words"))


def _search(spark, d, matcher: token_matcher.TokenMatcher) -> DataFrame:
    return matcher.find_words(_docs_for_search(spark, d))


def _as_doc(words: list[str]) -> dict:
    tokens, at = [], 0
    none = dict.fromkeys(("tag", "pos", "morphology", "lemma", "dep", "head"))
    for w in words:
        size = len(w.encode())
        tokens.append({"start": at, "end": at + size, "norm": w.lower(), **none})
        at += size
    return {"text": "".join(words), "tokens": tokens}


@query("tm_fixed2_window", SQL["tm_fixed2"])
def tm_fixed2_window(spark, d):
    """The same pattern as tm_fixed2 by the window plan, which also serves annotations."""
    return token_matcher.find_fixed(tok(spark, d), "r", [[_item("lower", "in", FUNCTION), _item("is_title", "flag", True)]]).select("doc_id", "start", "end")


_LOWER_FUNCTION = _item("lower", "in", FUNCTION, "one_or_more")
_RUNS = f"f AS (SELECT doc_id, i, lower(text) IN ({_IN(FUNCTION)}) AS hit FROM tok), g AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM f WHERE hit), runs AS (SELECT doc_id, min(i) AS a, max(i) + 1 AS b FROM g GROUP BY doc_id, island)"
_SPANS = 'SELECT doc_id, {}::INTEGER AS start, {}::INTEGER AS "end" FROM '


@query("tm_plus_all_runs", with_tok("SELECT doc_id, x::INTEGER AS start, y::INTEGER AS \"end\" FROM (SELECT doc_id, b, unnest(generate_series(a, b - 1)) AS x FROM runs) r, LATERAL (SELECT unnest(generate_series(r.x + 1, r.b)) AS y) s", _RUNS))
def tm_plus_all_runs(spark, d):
    return _search(spark, d, token_matcher.TokenMatcher().add("r", [[_LOWER_FUNCTION]])).select("doc_id", "start", "end")


# "of the" and "the" with two other words overlap in "the", nothing else does: the first keeps the former, the longest the latter.
_OTHER = [_item("is_alpha", "flag", True) | {"constraints": [*_item("is_alpha", "flag", True)["constraints"], *_item("lower", "not_in", ["the", "of"])["constraints"]]}]
_OVERLAPPING = [[_item("lower", "equals", "of"), _item("lower", "equals", "the")], [_item("lower", "equals", "the"), *_OTHER, *_OTHER]]
_OTHER_SQL = "regexp_full_match({0}, '\\p{{L}}+') AND lower({0}) NOT IN ('the', 'of')"
_OVERLAPS = (
    "n3 AS (SELECT doc_id, i, text, lag(text, 1) OVER w AS b1, lead(text, 1) OVER w AS t1, lead(text, 2) OVER w AS t2, lead(text, 3) OVER w AS t3 FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY i)),"
    f" two AS (SELECT doc_id, i AS a, i + 2 AS b, coalesce({_OTHER_SQL.format('t2')} AND {_OTHER_SQL.format('t3')}, false) AS met FROM n3 WHERE lower(text) = 'of' AND lower(t1) = 'the'),"
    f" three AS (SELECT doc_id, i AS a, i + 3 AS b, coalesce(lower(b1) = 'of', false) AS met FROM n3 WHERE lower(text) = 'the' AND {_OTHER_SQL.format('t1')} AND {_OTHER_SQL.format('t2')})"
)


def _greedy(how: str, whole: str, other: str) -> None:
    sql = _SPANS.format("a", "b") + f"(SELECT * FROM {whole} UNION ALL SELECT * FROM {other} WHERE NOT met)"
    query(f"tm_greedy_{how}", with_tok(sql, _OVERLAPS))(lambda spark, d: _search(spark, d, token_matcher.TokenMatcher(lexical.Lexicon()).add("r", _OVERLAPPING, how)).select("doc_id", "start", "end"))


_greedy("first", "two", "three")
_greedy("longest", "three", "two")


@query("tm_optional", with_tok(f"SELECT doc_id, i::INTEGER AS start, (i + 1 + n)::INTEGER AS \"end\" FROM nx, (SELECT unnest([0, 1]) AS n) WHERE lower(text) = 'the' AND (n = 0 OR lower(t1) IN ({_IN(FUNCTION)}))", _NEXT))
def tm_optional(spark, d):
    return _search(spark, d, token_matcher.TokenMatcher().add("r", [[_item("lower", "equals", "the"), _item("lower", "in", FUNCTION, "optional")]])).select("doc_id", "start", "end")


@query("tm_range", with_tok("SELECT doc_id, x::INTEGER AS start, (x + n)::INTEGER AS \"end\" FROM (SELECT doc_id, b, unnest(generate_series(a, b - 1)) AS x FROM runs), (SELECT unnest([2, 3]) AS n) WHERE x + n <= b", _RUNS))
def tm_range(spark, d):
    return _search(spark, d, token_matcher.TokenMatcher().add("r", [[_item("lower", "in", FUNCTION, "range", min=2, max=3)]])).select("doc_id", "start", "end")


# ---- phrases -------------------------------------------------------------------------------------------------------

_WORDS = f"regexp_extract_all(text, '{REGEX}')"


def _phrases(spark, d, key: Callable[[F.Column], F.Column]) -> DataFrame:
    """The first two, three, four and eight words of every benchmark item, and all of them."""
    w = F.regexp_extract_all(F.col("text"), F.lit(REGEX), F.lit(0))
    items = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").cast("string").alias("rule"), F.transform(w, key).alias("w"))
    items = items.withColumn("n", F.explode(F.array(*map(F.lit, (2, 3, 4, 8)), F.size("w"))))
    return items.where((F.size("w") >= F.col("n")) & (F.col("n") > 0)).select("rule", F.slice("w", F.lit(1), F.col("n")).alias("keys")).distinct()


def _phrase_query(name: str, key: Callable[[F.Column], F.Column], key_sql: str, by_join: bool = False) -> None:
    """Phrases in a document's own array, or by joins where that is asked for or the dictionary is large."""

    def run(spark, d):
        phrases = _phrases(spark, d, key)
        words = F.regexp_extract_all(F.col("text"), F.lit(REGEX), F.lit(0))
        found = None if by_join else phrase_matcher.find_in_rows(docs_of(spark, d).select("doc_id", F.transform(words, key).alias("keys")), phrases)
        if found is None:
            t, ahead = keyed(spark, d, key, 3)
            found = phrase_matcher.find_by_join(t, phrases, "key", ahead=ahead)
        return found.select("doc_id", "rule", "start", "end")

    sql = (
        f"WITH dw AS (SELECT doc_id, list_transform(w, lambda text: {key_sql}) AS w FROM {WORDS_SQL}),"
        f" ph AS (SELECT DISTINCT rule, w[1:n] AS keys FROM (SELECT rule, w, unnest([2, 3, 4, 8, len(w)]) AS n FROM (SELECT item_id::VARCHAR AS rule, list_transform({_WORDS}, lambda text: {key_sql}) AS w FROM benchmark)) WHERE len(w) >= n AND n > 0),"
        " g AS (SELECT doc_id, i, w[i] AS k, w[i + 1] AS k1 FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM dw)),"
        " c AS (SELECT doc_id, rule, i, keys FROM g JOIN ph ON k = keys[1] AND (len(keys) < 2 OR k1 = keys[2]))"
        " SELECT doc_id, rule, (i - 1)::INTEGER AS start, (i - 1 + len(keys))::INTEGER AS \"end\" FROM c JOIN dw USING (doc_id) WHERE w[i:i + len(keys) - 1] = keys"
    )
    query(name, sql)(run)


_phrase_query("pm_orth", lambda t: t, "text")
_phrase_query("pm_lower", F.lower, "lower(text)")
_phrase_query("pm_join", F.lower, "lower(text)", by_join=True)


@query("pm_length", with_tok("SELECT doc_id, i::INTEGER AS start, (i + 3)::INTEGER AS \"end\" FROM nx WHERE length(text) = 9 AND length(t1) = 1 AND length(t2) = 9", _NEXT))
def pm_length(spark, d):
    phrases = spark.createDataFrame([("r", ["9", "1", "9"])], "rule string, keys array<string>")
    t, ahead = keyed(spark, d, lambda x: F.length(x).cast("string"), 2)
    return phrase_matcher.find_by_join(t, phrases, "key", ahead=ahead).select("doc_id", "start", "end")


@query("pm_flag", with_tok("SELECT doc_id, i::INTEGER AS start, (i + 2)::INTEGER AS \"end\" FROM nx WHERE regexp_full_match(text, '\\p{Nd}+') AND regexp_full_match(t1, '\\p{Nd}+') = false", _NEXT))
def pm_flag(spark, d):
    phrases = spark.createDataFrame([("r", ["true", "false"])], "rule string, keys array<string>")
    t, ahead = keyed(spark, d, lambda x: lexical.flag_col("is_digit", x).cast("string"), 1)
    return phrase_matcher.find_by_join(t, phrases, "key", ahead=ahead).select("doc_id", "start", "end")


@query("pm_overlap", with_tok("SELECT doc_id, 'a' AS rule, i::INTEGER AS start, (i + 2)::INTEGER AS \"end\" FROM nx WHERE lower(text) = 'of' AND lower(t1) = 'the' UNION ALL SELECT doc_id, 'b', i::INTEGER, (i + 1)::INTEGER FROM nx WHERE lower(text) = 'the'", _NEXT))
def pm_overlap(spark, d):
    from .operators.kernels import per_document

    m = phrase_matcher.PhraseMatcher("lower").add("a", [["of", "the"]]).add("b", [["the"]])
    trie = m.trie()
    run = lambda row: [{"doc_id": row["doc_id"], "rule": r, "start": a, "end": b} for r, a, b in m.matches(_as_doc(row["words"] or []), trie)]
    return per_document(_docs_for_search(spark, d), run, "doc_id bigint, rule string, start int, end int")


# ---- trees ---------------------------------------------------------------------------------------------------------


def heap_docs(spark, d):
    words = F.regexp_extract_all(F.col("text"), F.lit(REGEX), F.lit(0))
    head = lambda i: (i - i % WINDOW + F.greatest(F.lit(0), F.floor((i % WINDOW - 1) / 2))).cast("int")
    return docs_of(spark, d).select("doc_id", F.transform(words, lambda w, i: F.struct(w.alias("text"), head(i).alias("head"))).alias("tokens"))


def heap_tokens(spark, d):
    """The token table with heads and graph columns."""
    return trees.with_graph(heap_docs(spark, d), ("text",))


_HEAP = (
    "h AS (SELECT doc_id, i, text, i - i % 31 AS root, i % 31 AS k, i - i % 31 + greatest(0, (i % 31 - 1) // 2) AS head FROM tok),"
    " a AS (SELECT *, (k - 1) // 2 AS p1, ((k - 1) // 2 - 1) // 2 AS p2, (((k - 1) // 2 - 1) // 2 - 1) // 2 AS p3 FROM h),"
    " t AS (SELECT doc_id, i, text, root, head, CASE WHEN k > 0 THEN root + p1 END AS a1, CASE WHEN k > 2 THEN root + p2 END AS a2, CASE WHEN k > 6 THEN root + p3 END AS a3, CASE WHEN k > 14 THEN root END AS a4 FROM a)"
)
_UP = "coalesce(R.i IN (L.a1, L.a2, L.a3, L.a4), false)"
_DOWN = "coalesce(L.i IN (R.a1, R.a2, R.a3, R.a4), false)"


def _relation(name: str, relation: str) -> None:
    """The relation's pairs with every token on the left, counted per document."""

    def run(spark, d):
        pairs = trees.related_pairs(heap_docs(spark, d), relation)
        return pairs.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("l").cast("long") * 3 + F.col("r")).alias("digest"))

    condition = {"<<": f"R.i <> L.i AND {_UP}", ">>": f"R.i <> L.i AND {_DOWN}"}.get(relation, trees.RELATIONS[relation])
    query(f"dep_rel_{name}", with_tok(f"SELECT L.doc_id, count(*) AS n, sum(L.i * 3 + R.i)::BIGINT AS digest FROM t L JOIN t R ON L.doc_id = R.doc_id AND L.root = R.root AND {condition} GROUP BY L.doc_id", _HEAP))(run)


def _relation_by_join(name: str, relation: str) -> None:
    """The same pairs by the join over the token table, which also serves tokens of one document on many rows."""

    def run(spark, d):
        t = heap_tokens(spark, d).select("doc_id", "i", "head", "root", "entry", "exit")
        pairs = trees.join_relation(t, t.select(*t.columns), relation)
        return pairs.groupBy(F.col("L.doc_id").alias("doc_id")).agg(F.count("*").alias("n"), F.sum(F.col("L.i").cast("long") * 3 + F.col("R.i")).alias("digest"))

    query(f"dep_join_{name}", SQL[f"dep_rel_{name}"])(run)


for _name, _op in trees.RELATION_NAMES.items():
    _relation(_name, _op)
for _name in ("child", "descendant", "right_sibling"):
    _relation_by_join(_name, trees.RELATION_NAMES[_name])


def _dep(name: str, nodes: list, sql: str) -> None:
    def run(spark, d):
        found = dependency_matcher.find_in_rows(heap_docs(spark, d), nodes)
        return found.select("doc_id", *[F.col("tokens")[k].alias(f"t{k}") for k in range(len(nodes))])

    query(name, sql)(run)


_node = lambda i, cs=(), left=None, rel=None: {"id": i, "constraints": list(cs), "link": {"left": left, "relation": rel} if left else None}
_low = lambda *v: [{"attribute": "lower", "predicate": {"kind": "in", "values": list(v)}}]
_dep(
    "dep_3node",
    [_node("a", _low("the", "de")), _node("b", (), "a", ">"), _node("c", _low("of", "la"), "b", ".*")],
    with_tok("SELECT A.doc_id, A.i::INTEGER AS t0, B.i::INTEGER AS t1, C.i::INTEGER AS t2 FROM t A JOIN t B ON A.doc_id = B.doc_id AND A.root = B.root AND B.head = A.i AND B.i <> A.i JOIN t C ON C.doc_id = B.doc_id AND C.root = B.root AND C.i > B.i WHERE lower(A.text) IN ('the', 'de') AND lower(C.text) IN ('of', 'la')", _HEAP),
)
_dep(
    "dep_duplicates",
    [_node("a", _low("the", "de")), _node("b", (), "a", ">"), _node("c", (), "a", ">")],
    with_tok("SELECT A.doc_id, A.i::INTEGER AS t0, B.i::INTEGER AS t1, C.i::INTEGER AS t2 FROM t A JOIN t B ON A.doc_id = B.doc_id AND A.root = B.root AND B.head = A.i AND B.i <> A.i JOIN t C ON C.doc_id = A.doc_id AND C.root = A.root AND C.head = A.i AND C.i <> A.i WHERE lower(A.text) IN ('the', 'de')", _HEAP),
)
_dep(
    "dep_reused_token",
    [_node("a", _low("the", "de")), _node("b", (), "a", ">"), _node("c", (), "b", "<")],
    with_tok("SELECT A.doc_id, A.i::INTEGER AS t0, B.i::INTEGER AS t1, A.i::INTEGER AS t2 FROM t A JOIN t B ON A.doc_id = B.doc_id AND A.root = B.root AND B.head = A.i AND B.i <> A.i WHERE lower(A.text) IN ('the', 'de')", _HEAP),
)


@query("trav_children", with_tok("SELECT doc_id, head::INTEGER AS i, count(*) AS n, min(i)::INTEGER AS first, max(i)::INTEGER AS last FROM t WHERE i <> head GROUP BY doc_id, head", _HEAP))
def trav_children(spark, d):
    kids = trees.children(tok(spark, d).withColumn("head", (F.col("i") - F.col("i") % WINDOW + F.greatest(F.lit(0), F.floor((F.col("i") % WINDOW - 1) / 2))).cast("int")))
    return kids.select("doc_id", "i", F.size("children").cast("long").alias("n"), F.element_at("children", 1).alias("first"), F.element_at("children", -1).alias("last"))


def _traversal(spark, d):
    return trees.traversal(heap_docs(spark, d).withColumn("sentences", F.lit(None).cast(DOC["sentences"])))


@query("trav_ancestors", with_tok("SELECT doc_id, i::INTEGER AS i, k::INTEGER AS level, a::INTEGER AS ancestor FROM (SELECT doc_id, i, unnest([a1, a2, a3, a4]) AS a, unnest([1, 2, 3, 4]) AS k FROM t) WHERE a IS NOT NULL", _HEAP))
def trav_ancestors(spark, d):
    """Every ancestor of every token, from its parent to its root."""
    return trees.ancestor_pairs(heap_docs(spark, d))


@query("trav_subtree_set", with_tok(f"SELECT L.doc_id, L.i::INTEGER AS i, count(*) AS n, sum(R.i)::BIGINT AS members FROM t L JOIN t R ON L.doc_id = R.doc_id AND L.root = R.root AND (L.i = R.i OR {_DOWN}) GROUP BY L.doc_id, L.i", _HEAP))
def trav_subtree_set(spark, d):
    return _traversal(spark, d).select("doc_id", "i", F.size("subtree").cast("long").alias("n"), F.aggregate("subtree", F.lit(0).cast("long"), lambda s, x: s + x).alias("members"))


@query("trav_sentence", with_tok("SELECT doc_id, i::INTEGER AS i, root::INTEGER AS start, (1 + max(i) OVER (PARTITION BY doc_id, root))::INTEGER AS \"end\" FROM t", _HEAP))
def trav_sentence(spark, d):
    from .operators.kernels import per_document

    run = lambda row: [{"doc_id": row["doc_id"], "i": i, "start": s["start"], "end": s["end"]} for s in annotators.sentences_of([t["head"] for t in row["tokens"] or []]) for i in range(s["start"], s["end"])]
    return per_document(heap_docs(spark, d), run, "doc_id bigint, i int, start int, end int")


#: Windows of five tokens in which the last is the root, the fourth its child, and the first two hang on the third, it on the last.
_RIGHT = "CASE i % 5 WHEN 0 THEN i + 2 WHEN 1 THEN i + 1 WHEN 2 THEN i + 2 WHEN 3 THEN i + 1 ELSE i END"


def right_docs(spark, d):
    """Documents whose heads stand to the right; a head past the end is the token itself."""
    words = F.regexp_extract_all(F.col("text"), F.lit(REGEX), F.lit(0))
    step = lambda i: F.element_at(F.array(*map(F.lit, (2, 1, 2, 1, 0))), (i % 5 + 1).cast("int"))
    docs = docs_of(spark, d).select("doc_id", words.alias("w"))
    head = lambda i: F.when(i + step(i) < F.size("w"), i + step(i)).otherwise(i).cast("int")
    return docs.select("doc_id", F.transform("w", lambda x, i: F.struct(x.alias("text"), head(i).alias("head"))).alias("tokens"))


_RIGHT_HEADS = f"q AS (SELECT doc_id, i, text, ({_RIGHT}) AS h, count(*) OVER (PARTITION BY doc_id) AS n FROM tok), rt AS (SELECT doc_id, i, text, CASE WHEN h < n THEN h ELSE i END AS head FROM q)"
_EDGE = (
    f"{_RIGHT_HEADS}, x1 AS (SELECT r.doc_id, r.i, r.head, p.head AS h2 FROM rt r JOIN rt p ON p.doc_id = r.doc_id AND p.i = r.head), x2 AS (SELECT x.*, p.head AS h3 FROM x1 x JOIN rt p ON p.doc_id = x.doc_id AND p.i = x.h2),"
    " below AS (SELECT doc_id, i AS top, i FROM rt UNION ALL SELECT doc_id, head, i FROM x2 UNION ALL SELECT doc_id, h2, i FROM x2 UNION ALL SELECT doc_id, h3, i FROM x2)"
)


@query("left_edge", with_tok("SELECT doc_id, top::INTEGER AS i, min(i)::INTEGER AS edge FROM below GROUP BY doc_id, top", _EDGE))
def left_edge(spark, d):
    """The least token below every token, in trees whose heads stand to the right."""
    from .operators.kernels import per_document

    run = lambda row: [{"doc_id": row["doc_id"], "i": i, "edge": e} for i, e in enumerate(trees.left_edges([t["head"] for t in row["tokens"] or []]))]
    return per_document(right_docs(spark, d), run, "doc_id bigint, i int, edge int")


@query("tree_bounds", with_tok("SELECT doc_id, root::INTEGER AS root, min(i)::INTEGER AS lo, max(i)::INTEGER + 1 AS hi, count(*) AS n, max(CASE WHEN a4 IS NOT NULL THEN 4 WHEN a3 IS NOT NULL THEN 3 WHEN a2 IS NOT NULL THEN 2 WHEN a1 IS NOT NULL THEN 1 ELSE 0 END)::INTEGER AS depth FROM t GROUP BY doc_id, root", _HEAP))
def tree_bounds(spark, d):
    return trees.with_graph(heap_docs(spark, d)).groupBy("doc_id", "root").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n"), F.max("depth").alias("depth"))


# ---- entities and groups -------------------------------------------------------------------------------------------

_TAGS = "tg AS (SELECT doc_id, i, text, CASE WHEN length(text) % 5 = 0 THEN 'B' WHEN length(text) % 5 IN (1, 2) AND i % 2 = 0 THEN 'I' WHEN i % 7 = 0 THEN NULL ELSE 'O' END AS iob, CASE WHEN length(text) % 5 < 3 THEN chr((65 + length(text) % 2)::INTEGER) END AS kind FROM tok)"


def tagged(spark, d):
    n = F.length("text")
    iob = F.when(n % 5 == 0, "B").when((n % 5).isin(1, 2) & (F.col("i") % 2 == 0), "I").when(F.col("i") % 7 == 0, F.lit(None)).otherwise("O")
    return tok(spark, d).withColumns({"entity_iob": iob, "entity_type": F.when(n % 5 < 3, F.chr(65 + n % 2)), "entity_id": F.lit(None).cast("string")})


_LAG = "rp AS (SELECT doc_id, i, kind, CASE WHEN iob = 'I' AND i > 0 AND (coalesce(lag(iob) OVER w, 'O') NOT IN ('B', 'I') OR coalesce(lag(kind) OVER w, '') <> coalesce(kind, '')) THEN 'B' ELSE iob END AS iob FROM tg WINDOW w AS (PARTITION BY doc_id ORDER BY i))"


def tag_docs(spark, d):
    """doc_id and the tags of tagged() as each document's own array."""
    w = docs_of(spark, d).select("doc_id", F.regexp_extract_all(F.col("text"), F.lit(REGEX), F.lit(0)).alias("w"))

    def one(t, i):
        n = F.length(t)
        iob = F.when(n % 5 == 0, "B").when((n % 5).isin(1, 2) & (i % 2 == 0), "I").when(i % 7 == 0, F.lit(None)).otherwise("O")
        return F.struct(iob.alias("iob"), F.when(n % 5 < 3, F.chr(65 + n % 2)).alias("kind"), F.lit(None).cast("string").alias("id"))

    return w.select("doc_id", F.transform("w", one).alias("tags"))


def repaired_docs(spark, d):
    return tag_docs(spark, d).select("doc_id", entities.repair_array(F.col("tags")).alias("tags"))


@query("ent_repair", with_tok("SELECT doc_id, coalesce(iob, '') AS iob, count(*) AS n, sum(i)::BIGINT AS places FROM rp GROUP BY ALL", f"{_TAGS}, {_LAG}"))
def ent_repair(spark, d):
    tags = repaired_docs(spark, d).select("doc_id", F.posexplode("tags").alias("i", "t"))
    return tags.groupBy("doc_id", F.coalesce("t.iob", F.lit("")).alias("iob")).agg(F.count("*").alias("n"), F.sum("i").alias("places"))


query("ent_repair_window", SQL["ent_repair"])(
    lambda spark, d: tagged(spark, d).withColumn("iob", F.coalesce(entities.repair_column(), F.lit(""))).groupBy("doc_id", "iob").agg(F.count("*").alias("n"), F.sum("i").alias("places"))
)


@query("ent_derive", with_tok("SELECT doc_id, min(i)::INTEGER AS start, (max(i) + 1)::INTEGER AS \"end\", arg_min(kind, i) AS label FROM (SELECT *, sum(CASE WHEN coalesce(iob, '') = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM rp) GROUP BY doc_id, g HAVING arg_min(coalesce(iob, ''), i) = 'B' AND arg_min(coalesce(kind, ''), i) <> ''", f"{_TAGS}, {_LAG}"))
def ent_derive(spark, d):
    return entities.entities_in_rows(tag_docs(spark, d)).select("doc_id", "start", "end", "label")


@query("ent_derive_array", SQL["ent_derive"])
def ent_derive_array(spark, d):
    """The same by expressions over the document's array."""
    spans = repaired_docs(spark, d).select("doc_id", F.explode(entities.entity_array(F.col("tags"))).alias("s"))
    return spans.select("doc_id", "s.start", "s.end", "s.label")


query("ent_derive_window", SQL["ent_derive"])(lambda spark, d: entities.derive_entities(tagged(spark, d).withColumn("entity_iob", entities.repair_column())).select("doc_id", "start", "end", "label"))


def _set_counts(spark, d, update: dict):
    """doc_id, iob, kind, n, places: the count and the sum of positions of every tag over all tokens of a document."""
    from .operators.kernels import per_document

    def run(row: dict) -> list[dict]:
        n = row["n"]
        held = {k: [s for s in v if s["end"] <= n] for k, v in update.items() if k != "default"}
        found: dict = {}
        for i, (iob, kind, _) in enumerate(entities.set_entities([("O", None, None)] * n, held | {"default": update["default"]})):
            count, places = found.get((iob or "", kind or ""), (0, 0))
            found[iob or "", kind or ""] = (count + 1, places + i)
        return [{"doc_id": row["doc_id"], "iob": iob, "kind": kind, "n": c, "places": p} for (iob, kind), (c, p) in found.items()]

    n = F.size(F.regexp_extract_all(F.col("text"), F.lit(REGEX), F.lit(0))).alias("n")
    return per_document(docs_of(spark, d).select("doc_id", n), run, "doc_id bigint, iob string, kind string, n bigint, places bigint")


_ALL = "s AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id) AS n FROM tok)"
_COUNTED = "SELECT doc_id, iob, kind, count(*) AS n, sum(i)::BIGINT AS places FROM ({}) GROUP BY doc_id, iob, kind"


@query("ent_set", with_tok(_COUNTED.format("SELECT doc_id, i, CASE WHEN n >= 3 AND i = 1 THEN 'B' WHEN n >= 3 AND i = 2 THEN 'I' ELSE 'O' END AS iob, CASE WHEN n >= 3 AND i IN (1, 2) THEN 'ORG' ELSE '' END AS kind FROM s"), _ALL))
def ent_set(spark, d):
    return _set_counts(spark, d, {"entities": [{"start": 1, "end": 3, "label": "ORG", "id": None}], "default": "outside"})


@query("ent_blocked_missing", with_tok(_COUNTED.format("SELECT doc_id, i, CASE WHEN n >= 2 AND i < 2 THEN 'B' WHEN n >= 4 AND i IN (2, 3) THEN '' ELSE 'O' END AS iob, '' AS kind FROM s"), _ALL))
def ent_blocked_missing(spark, d):
    return _set_counts(spark, d, {"blocked": [{"start": 0, "end": 2}], "missing": [{"start": 2, "end": 4}], "default": "outside"})


def _spans(spark, d):
    """Three spans a document, by its id."""
    k = F.col("doc_id") % 5
    span = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    return docs_of(spark, d).select("doc_id", F.array(span(F.lit(0), F.lit(3)), span(k, k + 2), span(F.lit(6), F.lit(6) + k)).alias("spans"))


@query("group_overlap", "SELECT doc_id, doc_id % 5 < 3 AS overlap FROM documents")
def group_overlap(spark, d):
    return _spans(spark, d).select("doc_id", entities.has_overlap_col(F.col("spans")).alias("overlap"))


@query("group_keys", "SELECT doc_id, 'a,b,' || CASE WHEN doc_id % 2 = 0 THEN 'c' ELSE 'd' END AS keys FROM documents")
def group_keys(spark, d):
    from .operators.kernels import per_document

    def run(row: dict) -> list[dict]:
        g: list[dict] = []
        for k in ("a", "x", "b", "a", "c" if row["doc_id"] % 2 == 0 else "d"):
            g = entities.set_group(g, k, [{"start": 0, "end": 0}], 1)
        return [{"doc_id": row["doc_id"], "keys": ",".join(x["key"] for x in entities.remove_group(g, "x"))}]

    return per_document(docs_of(spark, d).select("doc_id"), run, "doc_id bigint, keys string")


# ---- rulers --------------------------------------------------------------------------------------------------------

_RULES = [{"label": "FUNC", "pattern": [_item("lower", "in", FUNCTION)]}, {"label": "PAIR", "pattern": [_item("lower", "equals", "of"), _item("lower", "equals", "the")], "id": "of-the"}]


def _ruled(spark, d, f: Callable[[dict], list[dict]], ddl: str) -> DataFrame:
    from .operators.kernels import per_document

    def run(row: dict) -> list[dict]:
        doc = _as_doc(row["words"] or [])
        doc |= {"doc_id": row["doc_id"], "entities": None, "span_groups": []}
        for t in doc["tokens"]:
            t.update(entity_iob=None, entity_type=None, entity_id=None)
        return f(doc)

    return per_document(_docs_for_search(spark, d), run, ddl)


_MATCHES = f"m AS (SELECT doc_id, 'FUNC' AS label, i AS a, i + 1 AS b FROM nx WHERE lower(text) IN ({_IN(FUNCTION)}) UNION ALL SELECT doc_id, 'PAIR', i, i + 2 FROM nx WHERE lower(text) = 'of' AND lower(t1) = 'the')"
_FREE = "p AS (SELECT * FROM m WHERE label = 'PAIR'), kept AS (SELECT * FROM p UNION ALL SELECT m.* FROM m WHERE label = 'FUNC' AND NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = m.doc_id AND (p.a = m.a OR p.a = m.a - 1)))"
_ROWS = 'SELECT doc_id, label, a::INTEGER AS start, b::INTEGER AS "end" FROM '


@query("er_matches", with_tok(_ROWS + "m", f"{_NEXT}, {_MATCHES}"))
def er_matches(spark, d):
    r = rulers.EntityRuler().add(_RULES)
    run = r.compiled()
    names = {r.name(p): p.label for p in r.patterns}
    return _ruled(spark, d, lambda doc: [{"doc_id": doc["doc_id"], "label": names[n], "start": a, "end": b} for n, a, b in run(doc)], "doc_id bigint, label string, start int, end int")


@query("er_annotate", with_tok(_ROWS + "kept", f"{_NEXT}, {_MATCHES}, {_FREE}"))
def er_annotate(spark, d):
    r = rulers.EntityRuler().add(_RULES)
    run = r.compiled()
    return _ruled(spark, d, lambda doc: [{"doc_id": doc["doc_id"], **{k: s[k] for k in ("label", "start", "end")}} for s in r.annotated(doc, run(doc))["entities"] or []], "doc_id bigint, label string, start int, end int")


def _sr(name: str, source: str, **options) -> None:
    def run(spark, d):
        r = rulers.SpanRuler(**options).add(_RULES)
        find = r.compiled()
        rows = lambda doc: [{"doc_id": doc["doc_id"], **{k: s[k] for k in ("label", "start", "end")}} for s in r.annotated(doc, find(doc))["span_groups"][0]["spans"]]
        return _ruled(spark, d, rows, "doc_id bigint, label string, start int, end int")

    query(name, with_tok(_ROWS + source, f"{_NEXT}, {_MATCHES}, {_FREE}"))(run)


_sr("sr_matches", "m")
_sr("sr_filter_first_longest", "kept", spans_filter="first_longest")
_sr("sr_filter_new", "kept", spans_filter="prioritize_new")
_sr("sr_filter_existing", "kept", spans_filter="prioritize_existing")


# ---- vectors -------------------------------------------------------------------------------------------------------


def _embeddings(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet")


@query("vec_mean_by_label", "SELECT label, (d - 1)::INTEGER AS dim, round(avg(x::DOUBLE), 6) AS value FROM (SELECT label, generate_subscripts(embedding, 1) AS d, unnest(embedding) AS x FROM embeddings) GROUP BY label, d")
def vec_mean_by_label(spark, d):
    return vectors.mean_vectors(_embeddings(spark, d), "label", "embedding", 64).select("label", "dim", F.round("value", 6).alias("value"))


_EVERY = 50


@query("vec_cosine_topk", f"WITH q AS (SELECT vec_id AS q, embedding AS e FROM embeddings WHERE vec_id % {_EVERY} = 0), s AS (SELECT q, vec_id, round(list_cosine_similarity(e::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM q JOIN embeddings ON vec_id <> q) SELECT q, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5")
def vec_cosine_topk(spark, d):
    """The five most similar vectors of every fiftieth id; the queries, a fiftieth of the table, go to all workers."""
    e = _embeddings(spark, d).select("vec_id", "embedding")
    found = vectors.nearest(e, e.where(F.col("vec_id") % _EVERY == 0), 5)
    w = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("r", F.row_number().over(w)).where("r <= 5").select("q", "vec_id", "score")


@query(
    "vec_similarity",
    "SELECT a.vec_id, round(CASE WHEN a.label = b.label THEN 1 WHEN a.vec_id % 7 = 0 THEN 0 ELSE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) END, 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
)
def vec_similarity(spark, d):
    """Each vector and the next one: 1 where they stand for the same, 0 where one is all zeros, else their cosine."""
    e = _embeddings(spark, d)
    zero = F.transform("embedding", lambda x: x * 0)
    a = e.select("vec_id", F.when(F.col("vec_id") % 7 == 0, zero).otherwise(F.col("embedding")).alias("x"), F.col("label").alias("l"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"), F.col("label").alias("m"))
    return a.join(b, "vec_id").select("vec_id", F.round(vectors.similarity(F.col("x"), F.col("y"), F.col("l") == F.col("m")), 6).alias("score"))


# ---- rule annotators, snapshots, streams ---------------------------------------------------------------------------

_INDEX = ("the", "of", "thing", "er", "in", "re", "on", "ou", "an")


@query("attr_rules_toy", with_tok("SELECT doc_id, pos, count(*) AS n FROM (SELECT doc_id, CASE WHEN regexp_full_match(text, '\\p{Nd}+') THEN 'NUM' WHEN lower(text) IN ('the', 'a') THEN 'DET' WHEN lower(text) IN ('of', 'in') THEN 'ADP' ELSE 'X' END AS pos FROM tok) GROUP BY ALL"))
def attr_rules_toy(spark, d):
    from .operators.kernels import per_document

    rules = [annotators.AttributeRule(([_item("text", "not_in", [])],), {"pos": "X"}), annotators.AttributeRule(([_item("lower", "in", ["of", "in"])],), {"pos": "ADP"}), annotators.AttributeRule(([_item("lower", "in", ["the", "a"])],), {"pos": "DET"}), annotators.AttributeRule(([_item("is_digit", "flag", True)],), {"pos": "NUM"})]
    m = token_matcher.TokenMatcher(lexical.Lexicon())
    for k, r in enumerate(rules):
        m = m.add(str(k), r.patterns)
    search = m.compiled()
    run = lambda row: [{"doc_id": row["doc_id"], "pos": t["pos"]} for t in annotators.apply_attribute_rules(_as_doc(row["words"] or []), rules, search)["tokens"]]
    return per_document(_docs_for_search(spark, d), run, "doc_id bigint, pos string").groupBy("doc_id", "pos").agg(F.count("*").alias("n"))


@query("tokenize_rules")
def tokenize_rules(spark, d):
    """The rule tokenizer with the small built-in rules, as a token table."""
    docs = tokenize(docs_of(spark, d), TokenizerRules(exceptions={"can't": (("ca", None), ("n't", "not"))}))
    return explode_tokens(docs).select("doc_id", "i", "text", "start", "end", "idx", "whitespace")


@query("snapshot_roundtrip", "SELECT doc_id, strlen(text)::BIGINT AS bytes, true AS same FROM documents")
def snapshot_roundtrip(spark, d):
    """Documents to snapshots and back: the text's bytes, and whether text and tokens came back unchanged."""
    rows = snapshot.to_snapshot(tokenize_regex_docs(docs_of(spark, d)), keep=("text", "tokens"))
    back = snapshot.from_snapshot(rows, keep={"text": "text_before", "tokens": "tokens_before"})
    same = F.col("text_before").eqNullSafe(F.col("text")) & F.to_json("tokens_before").eqNullSafe(F.to_json("tokens"))
    return back.select("doc_id", F.octet_length("text_before").cast("long").alias("bytes"), same.alias("same"))


@query("snapshot_validate", "SELECT doc_id, 'json' AS error_code FROM documents WHERE doc_id % 10 = 0 AND length(text) > 0")
def snapshot_validate(spark, d):
    """Every tenth document loses its first token, so its tokens no longer tile the text; the others are valid."""
    docs = tokenize_regex_docs(docs_of(spark, d))
    cut = F.when(F.col("doc_id") % 10 == 0, F.slice("tokens", F.lit(2), F.greatest(F.size("tokens") - 1, F.lit(0)))).otherwise(F.col("tokens"))
    return snapshot.validate_docs(docs.withColumn("tokens", cut)).select("doc_id", "error_code")


@query("explode_assemble", with_tok("SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id"))
def explode_assemble(spark, d):
    """Nested documents to the token table and back; counts the tokens that are not white space."""
    docs = tokenize_regex_docs(docs_of(spark, d))
    again = assemble_docs(explode_tokens(docs), docs_of(spark, d))
    return explode_tokens(again).where(~lexical.flag_col("is_space", F.col("text"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("stream_annotate", with_tok("SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id"))
def stream_annotate(spark, d):
    """The documents as a stream through the token plan to a Parquet sink, read back."""
    schema = spark.read.parquet(f"{d}/documents.parquet").schema
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    plan = lambda s: s.select("doc_id", F.size(F.regexp_extract_all(F.col("text"), F.lit(REGEX), F.lit(0))).cast("long").alias("n")).where("n > 0")
    annotate_stream(plan(read_documents(spark, f"{d}/documents.parque[t]", schema)), lambda s: s, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.schema("doc_id bigint, n bigint").parquet(f"{base}/out")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Function word and capitalised word, counted by pair: tokens, a fixed pattern as a filter, an aggregate."""
    hits = token_matcher.find_fixed_ahead(tok_ahead(spark, d, 1), "r", [[_item("lower", "in", FUNCTION), _item("is_title", "flag", True)]])
    return hits.groupBy("doc_id").agg(F.count("*").alias("matches"), F.min("start").alias("first"))


from . import operator_queries  # noqa: E402, F401  registers its queries here

__all__ = ["QUERIES", "SQL", "flagship"]
