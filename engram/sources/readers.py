"""Readers: chat archives, lorebooks, characters, wiki exports, collection exports, PNG containers."""

from __future__ import annotations

import base64
import struct
import zlib
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.cleaning import Rule, clean

MESSAGE = T.StructType([T.StructField("name", T.StringType()), T.StructField("mes", T.StringType()), T.StructField("text", T.StringType()), T.StructField("content", T.StringType()), T.StructField("is_user", T.BooleanType()), T.StructField("is_system", T.BooleanType()), T.StructField("send_date", T.StringType())])
USER_NAMES = ("you", "user", "me", "myself")


def _messages(rows: DataFrame) -> DataFrame:
    """(chat_id, idx, name, mes, is_user, send_date) without system and empty messages."""
    text = F.coalesce(F.nullif("m.mes", F.lit("")), F.nullif("m.text", F.lit("")), F.nullif("m.content", F.lit("")))
    out = rows.where(~F.coalesce("m.is_system", F.lit(False)) & (F.trim(F.coalesce(text, F.lit(""))) != ""))
    return out.select("chat_id", "idx", F.col("m.name").alias("name"), text.alias("mes"), F.coalesce("m.is_user", F.lit(False)).alias("is_user"), F.col("m.send_date").alias("send_date"))


def chat_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Chats of one JSON message a line; a first line that describes the chat is left out. A file is a chat."""
    # a file may be read in parts: its lines are numbered by where their part begins and their order in it
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("chat_id"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))
    lines = rows.withColumn("idx", F.row_number().over(Window.partitionBy("chat_id").orderBy("at", "n")) - 1).where(F.trim("line") != "")
    head = F.get_json_object("line", "$.chat_metadata").isNotNull() | F.get_json_object("line", "$.user_name").isNotNull() | F.get_json_object("line", "$.character_name").isNotNull()
    return _messages(lines.where(~((F.col("idx") == 0) & F.coalesce(head, F.lit(False)))).select("chat_id", "idx", F.from_json("line", MESSAGE).alias("m")))


def chat_json(spark: SparkSession, path: str) -> DataFrame:
    """Chats as one JSON document: an array, an object with chat or messages, or a single message."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("chat_id"), F.trim("value").alias("v"))
    inner = F.when(F.col("v").startswith("["), F.col("v")).otherwise(F.coalesce(F.get_json_object("v", "$.chat"), F.get_json_object("v", "$.messages"), F.concat(F.lit("["), "v", F.lit("]"))))
    return _messages(whole.select("chat_id", F.posexplode(F.from_json(inner, T.ArrayType(MESSAGE))).alias("idx", "m")))


def chat_txt(spark: SparkSession, path: str) -> DataFrame:
    """`Name: text` lines are a chat if a file has more than two of them; another file is one document."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("chat_id"), "value")
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: x.rlike(r"^.+?:\s*.+$"))
    chat = F.size(lines) > 2
    said = F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^(.+?):\s*(.+)$", 1)).alias("name"), F.regexp_extract(x, r"^(.+?):\s*(.+)$", 2).alias("mes")))
    rows = whole.select("chat_id", F.posexplode(F.when(chat, said).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("name"), F.col("value").alias("mes"))))).alias("idx", "m"), chat.alias("is_chat"))
    return rows.select("chat_id", "idx", "m.name", "m.mes", F.coalesce(F.lower("m.name").isin(*USER_NAMES), F.lit(False)).alias("is_user"), "is_chat")


def documents(spark: SparkSession, path: str, rules: list[Rule] = ()) -> DataFrame:
    """A row for each file: path, text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), clean(F.col("value"), rules).alias("text"))


def lorebook(entries: DataFrame, rules: list[Rule] = (), per_entry: bool = True) -> DataFrame:
    """Entries (book, uid, comment, key, content) without empty ones as texts: a header line each, or a book in one text."""
    out = entries.withColumn("text", clean(F.col("content"), rules)).where("text <> ''")
    title = F.coalesce(F.nullif("comment", F.lit("")), F.element_at("key", 1), F.lit("Entry"))
    out = out.withColumn("text", F.concat(F.lit("# "), title, F.lit("\n"), "text"))
    if per_entry:
        return out
    return out.groupBy("book").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("uid", "text"))), lambda x: x["text"]), "\n\n---\n\n").alias("text"))


def character(cards: DataFrame, id_col: str, fields: list[str], per_field: bool = True) -> DataFrame:
    """Non-empty fields of a card as texts, or one text with a header for each."""
    rows = cards.unpivot([id_col], fields, "field", "text").where("trim(text) <> ''")
    if per_field:
        return rows
    order = F.create_map(*(F.lit(x) for i, f in enumerate(fields) for x in (f, i)))
    part = F.struct(F.element_at(order, F.col("field")).alias("o"), F.concat(F.lit("## "), "field", F.lit("\n"), "text").alias("t"))
    return rows.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "\n\n").alias("text"))


def keyset_page(rows: DataFrame, id_col: str, cursor: int | None, n: int) -> DataFrame:
    """The next n rows below the cursor, greatest id first, without deleted and blank ones."""
    out = rows.where(~F.coalesce("is_deleted", F.lit(False)) & (F.trim(F.coalesce("body", F.lit(""))) != ""))
    return (out if cursor is None else out.where(F.col(id_col) < cursor)).orderBy(F.col(id_col).desc()).limit(n)


def exported(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of export files with their collection's id; vectors if they have them.

    A file is one document with all chunks, on one line or many, or has a line for each chunk, as write_export makes it. An
    export without a list of chunks, or a line without one, is an error when it is read; an empty list gives no rows.
    """
    chunk = "struct<hash:bigint,text:string,vector:array<float>,metadata:map<string,string>>"
    schema = f"version string, collection struct<id:string,source:string,model:string>, chunk {chunk}, chunks array<{chunk}>"
    lines = spark.read.schema(f"{schema}, _broken string").option("columnNameOfCorruptRecord", "_broken").json(path).withColumn("_file", F.input_file_name())
    documents = [r[0] for r in lines.where("_broken IS NOT NULL AND version IS NULL").select("_file").distinct().collect()]  # names of files that go over several lines
    rows = lines.where(~F.col("_file").isin(documents)) if documents else lines
    rows = rows.drop("_file", "_broken")
    if documents:
        rows = rows.unionByName(spark.read.schema(schema).json([unquote(f) for f in documents], multiLine=True))
    none = F.raise_error(F.lit(f"{path} has an entry without chunks")).cast(f"array<{chunk}>")
    each = F.when(F.col("chunk").isNotNull(), F.array("chunk")).when(F.col("chunks").isNotNull(), F.col("chunks")).otherwise(none)
    return rows.select("version", F.col("collection.id").alias("collection_id"), F.col("collection.source").alias("source"), F.col("collection.model").alias("model"), F.explode(each).alias("c")).select("version", "collection_id", "source", "model", "c.*")


def import_errors(rows: DataFrame, source: str | None = None, model: str | None = None) -> DataFrame:
    """One row of numbers: what an import has and what is wrong with it. Vectors are used again if all rows have one of one size and the
    model is ours."""
    n = F.count("*")
    fits = F.lit(source is None) | F.every((F.col("source") == source) & (F.col("model") == model))
    finite = F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.agg(
        n.alias("chunks"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("without_text"), F.count_if(F.col("vector").isNotNull()).alias("with_vector"),
        F.count_if(~F.coalesce(F.col("version").startswith("1."), F.lit(False))).alias("bad_version"), F.count_if(F.col("vector").isNotNull() & ~finite).alias("bad_vectors"),
        F.countDistinct(F.when(F.col("vector").isNotNull(), F.size("vector"))).alias("dimensions"),
        ((F.count_if(F.col("vector").isNotNull()) == n) & (F.countDistinct(F.size("vector")) == 1) & fits).alias("vectors_usable"),
    )


PNG = b"\x89PNG\r\n\x1a\n"


def png_chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    if not data.startswith(PNG):
        raise ValueError("not a PNG")
    out, at = [], len(PNG)
    while at + 8 <= len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        out.append((data[at + 4 : at + 8], data[at + 8 : at + 8 + n]))
        at += 12 + n
    return out


def png_read(data: bytes, key: str) -> str | None:
    """The JSON text under a key of a zTXt or tEXt chunk."""
    for kind, body in png_chunks(data):
        name, _, rest = body.partition(b"\0")
        if name.decode("latin-1") == key and kind == b"zTXt":
            return base64.b64decode(zlib.decompress(rest[1:])).decode()
        if name.decode("latin-1") == key and kind == b"tEXt":
            return base64.b64decode(rest).decode()
    return None


def png_write(data: bytes, key: str, text: str) -> bytes:
    """The image with the text in a zTXt chunk before its end, in place of an earlier one."""
    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    own = key.encode("latin-1") + b"\0"
    parts = [(k, b) for k, b in png_chunks(data) if not (k in (b"zTXt", b"tEXt") and b.startswith(own))]
    body = own + b"\0" + zlib.compress(base64.b64encode(text.encode()))
    return PNG + b"".join(chunk(k, b) for k, b in parts if k != b"IEND") + chunk(b"zTXt", body) + chunk(b"IEND", b"")


def png_texts(spark: SparkSession, path: str, key: str) -> DataFrame:
    @F.pandas_udf("string")
    def read(contents: pd.Series) -> pd.Series:
        return contents.map(lambda b: png_read(bytes(b), key))

    return spark.read.format("binaryFile").load(path).select("path", read("content").alias("json"))


def export_rows(chunks: DataFrame, collection: Column, version: str = "1.0.0") -> DataFrame:
    """One JSON document a collection in pieces: a row for each chunk with its collection, to be written as JSON lines."""
    return chunks.select(F.lit(version).alias("version"), collection.alias("collection"), F.struct(*chunks.columns).alias("chunk"))


def write_export(chunks: DataFrame, collection: Column, path: str, version: str = "1.0.0") -> None:
    """The export as files of JSON lines."""
    export_rows(chunks, collection, version).write.mode("overwrite").json(path)
