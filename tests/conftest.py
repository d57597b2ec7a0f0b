import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from tessera.session import ship

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    yield ship(s)
    s.stop()


SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def token(text: str, at: int, **more) -> dict:
    fields = ("tag", "pos", "morphology", "lemma", "head", "dep", "sentence_start", "entity_iob", "entity_type", "entity_id")
    return {"start": at, "end": at + len(text.encode()), "idx": at, "whitespace": False, "norm": text.lower(), **dict.fromkeys(fields), **more}


@pytest.fixture
def make_doc():
    def make(words, **columns):
        tokens, at = [], 0
        for k, w in enumerate(words):
            tokens.append(token(w, at, **{c: v[k] for c, v in columns.items()}))
            at += len(w.encode())
        return {"doc_id": 1, "text": "".join(words), "tokens": tokens, "entities": None, "sentences": None, "noun_chunks": None, "tensor": [], "span_groups": []}

    return make
