"""The document model: one row a document with nested tokens, spans and span groups, and its exploded token table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = (
    "struct<start:int,end:int,idx:int,whitespace:boolean,norm:string,tag:string,pos:string,morphology:string,lemma:string,"
    "head:int,dep:string,sentence_start:boolean,entity_iob:string,entity_type:string,entity_id:string>"
)
SPAN = "struct<start:int,end:int,label:string,id:string>"
GROUP = f"struct<key:string,name:string,attrs:array<struct<key:string,json:string>>,spans:array<{SPAN}>>"
TOKEN_FIELDS = tuple(f.split(":")[0] for f in TOKEN[7:-1].split(","))
DOC = {
    "doc_id": "bigint", "text": "string", "tokens": f"array<{TOKEN}>", "entities": f"array<{SPAN}>", "sentences": f"array<{SPAN}>", "noun_chunks": f"array<{SPAN}>",
    "tensor": "array<array<float>>", "span_groups": f"array<{GROUP}>",
}
DOC_DDL = ", ".join(f"{k} {v}" for k, v in DOC.items())
#: The universal part-of-speech tags; fixed values.
POS_TAGS = ("ADJ", "ADP", "ADV", "AUX", "CONJ", "CCONJ", "DET", "INTJ", "NOUN", "NUM", "PART", "PRON", "PROPN", "PUNCT", "SCONJ", "SYM", "VERB", "X", "EOL", "SPACE")


def with_doc_columns(df: DataFrame) -> DataFrame:
    """df (at least doc_id, text) with every column of the model; those that are missing are null, groups and tensor empty."""
    empty = {"tensor": F.array(), "span_groups": F.array()}
    return df.select(*[(F.col(c) if c in df.columns else empty.get(c, F.lit(None))).cast(t).alias(c) for c, t in DOC.items()])


def token_text(text: str = "text", token: str = "token") -> F.Column:
    """The text of a token, by code points."""
    size = F.length(F.decode(F.substring(F.encode(F.col(text), "utf-8"), F.col(f"{token}.start") + 1, F.col(f"{token}.end") - F.col(f"{token}.start")), "utf-8"))
    return F.substring(F.col(text), F.col(f"{token}.idx") + 1, size)


def span_text(text: str = "text", tokens: str = "tokens", span: str = "span") -> F.Column:
    """The text of a span of tokens, without white space after its last token; nothing for an empty span."""
    start, end = F.col(f"{span}.start"), F.col(f"{span}.end")
    first, last = F.get(F.col(tokens), start)["start"], F.get(F.col(tokens), end - 1)["end"]
    return F.when(end <= start, F.lit("")).otherwise(F.decode(F.substring(F.encode(F.col(text), "utf-8"), first + 1, last - first), "utf-8"))


def explode_tokens(docs: DataFrame) -> DataFrame:
    """doc_id, i, text and the fields of every token."""
    t = docs.select("doc_id", "text", F.posexplode("tokens").alias("i", "token"))
    return t.select("doc_id", "i", token_text().alias("text"), *[F.col(f"token.{f}").alias(f) for f in TOKEN_FIELDS])


def assemble_docs(tokens: DataFrame, texts: DataFrame) -> DataFrame:
    """The inverse of explode_tokens: documents of `texts` (doc_id, text) with their tokens in order."""
    fields = F.struct(*[F.col(f).alias(f) for f in TOKEN_FIELDS])
    packed = tokens.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", fields.alias("t")))).alias("p"))
    packed = packed.select("doc_id", F.transform("p", lambda x: x["t"]).cast(DOC["tokens"]).alias("tokens"))
    return with_doc_columns(texts.select("doc_id", "text").join(packed, "doc_id", "left").withColumn("tokens", F.coalesce("tokens", F.array().cast(DOC["tokens"]))))


def codepoint_of_byte(text: F.Column, byte: F.Column) -> F.Column:
    """The code-point offset of a byte offset; null inside a character or past the end."""
    head = F.substring(F.encode(text, "utf-8"), F.lit(1), byte)
    safe = F.try_validate_utf8(head.cast("string"))
    return F.when((byte >= 0) & (byte <= F.octet_length(text)), F.length(safe))


def byte_of_codepoint(text: F.Column, offset: F.Column) -> F.Column:
    return F.when((offset >= 0) & (offset <= F.length(text)), F.octet_length(F.substring(text, F.lit(1), offset)))
