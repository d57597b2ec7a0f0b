"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import random
import statistics
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera import queries as engine
from tessera.operators.phrase_matcher import find_in_rows
from tessera.operators.token_matcher import TokenMatcher
from tessera.session import ship

HEADLINE = ("tokens_per_doc", "lex_shape", "lex_flags", "pred_in", "tm_fixed2", "tm_plus_all_runs", "tm_greedy_longest", "pm_lower", "dep_rel_child", "dep_3node", "ent_derive", "er_annotate", "trav_ancestors", "vec_mean_by_label", "vec_cosine_topk")


def _rules(spark, d) -> list[tuple[str, list[str]]]:
    """1,000 two-token rules with exact values over the 200 most frequent words."""
    t = engine.tok(spark, d)
    words = [r[0] for r in t.groupBy("text").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "text").limit(200).collect()]
    return [(f"r{i}", [words[i % 200], words[(7 * i + i // 200) % 200]]) for i in range(1000)]


def thousand_rules(spark, d):
    """The rules as phrases, by a trie in each document's row."""
    rules = spark.createDataFrame(_rules(spark, d), "rule string, keys array<string>")
    words = engine._docs_for_search(spark, d).withColumnRenamed("words", "keys")
    return find_in_rows(words, rules).groupBy("rule").agg(F.count("*").alias("n"))


def thousand_rules_matcher(spark, d):
    """The same rules by the token matcher."""
    rules = [(n, [[_text("equals", w) for w in words]]) for n, words in _rules(spark, d)]
    return TokenMatcher().add_all(rules).find_words(engine._docs_for_search(spark, d)).groupBy("rule").agg(F.count("*").alias("n"))


def _text(kind: str, value, repetition: str = "once", attribute: str = "text") -> dict:
    key = "values" if isinstance(value, list) else "value"
    return {"constraints": [{"attribute": attribute, "predicate": {"kind": kind, key: value}}], "repetition": {"kind": repetition}}


#: The published matcher workloads: mix, tokens, rules, vocabulary. Their words are drawn here, so counts of matches differ.
MATCHER = [("indexed", 1_000, 100, 200), ("indexed", 1_000, 10_000, 200), ("indexed", 10_000, 1_000, 200), ("indexed", 100_000, 100, 200), ("indexed", 100_000, 10_000, 200), ("indexed", 10_000, 10_000, 10_000), ("indexed", 1_000, 100_000, 100_000),
           ("mixed", 10_000, 1_000, 200), ("mixed", 100_000, 1_000, 200), ("unindexed", 1_000, 100, 200), ("unindexed", 10_000, 100, 200), ("unindexed", 10_000, 10_000, 200)]


def matcher_times() -> dict[str, float]:
    """Seconds of one matching call on one document, the median of five after a warm-up, in one Python process."""
    out = {}
    for mix, n, rules, vocabulary in MATCHER:
        r = random.Random(n + rules)
        words = [f"w{r.randrange(min(vocabulary, 9_973))}" for _ in range(n)]
        specs = []
        for k in range(rules):
            w, x = f"w{k % vocabulary}", f"w{(7 * k + 3) % vocabulary}"
            first = [[_text("equals", w)], [_text("equals", w), _text("equals", x)], [_text("in", [w], "one_or_more", "lower")]][k % 3]
            anywhere = [[_text("not_in", [x]), _text("equals", w)], [_text("equals", x, "optional"), _text("equals", w)], [_text("equals", x, "negated"), _text("equals", w)], [_text("equals", x, "zero_or_more"), _text("equals", w)]][k % 4]
            specs.append((f"r{k}", [first if mix == "indexed" or mix == "mixed" and k % 2 else anywhere]))
        search = TokenMatcher().add_all(specs).compiled()
        search.word_columns(words)
        took = []
        for _ in range(5):
            began = time.perf_counter()
            search.word_columns(words)
            took.append(time.perf_counter() - began)
        out[f"matcher_{mix}_{n}x{rules}x{vocabulary}"] = round(statistics.median(took), 5)
    return out


def main() -> None:
    cpus, d = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.files.maxPartitionBytes", "4m").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    run = {**{k: engine.QUERIES[k] for k in HEADLINE}, "thousand_rules": thousand_rules, "thousand_rules_matcher": thousand_rules_matcher}
    engine.tok(spark, d).agg(F.count("*")).collect()  # reads the table and starts workers once
    times = {}
    for name, f in run.items():
        began = time.time()
        f(spark, d).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    total = round(sum(times.values()), 3)
    times |= matcher_times()
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
