"""Documents rewritten as records by a model: batches, chains of batches that know what came before, repair, merge, links.

Batches and chains are columns; a chain, the batches of one long section, is folded in order by one task, and chains run side by
side. The model is a function (see extracted), so a test or a query can use one that is deterministic.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from . import packing
from .entities import ENTITY, grounded, merge, normal, parse_array, validate

BATCH_CHARS = 6000
#: Share of a section's facts that the records must have, facts from which a section counts, and facts named in a repair.
COVERAGE, LEAST_FACTS, NAMED_FACTS = 0.5, 3, 20
#: Slack of a name's and of a keyword's spelling against the source.
NAME_SLACK, KEYWORD_SLACK = 0.2, 0.3
_HEADER = r"^#{1,6}\s+.+$"
#: Fixed values, what counts as a fact of a section: figures, quoted terms, phrases of capitalised words, long words in lower case.
FACTS = [
    r"\$\s?\d[\d,.]*|\d[\d,.]*\s?%|\d{2,}(?:[.,]\d+)*",
    r'"([^"\n]{2,60})"|“([^”\n]{2,60})”|‘([^’\n]{2,60})’',
    r"(?:(?<=^)|(?<=[\s(]))'([^'\n]{2,60})'(?=[\s).,;:!?]|$)",
    r"\b[A-Z][\w'’-]*(?:[ \t]+(?:of|the|and|in|for|under|on|to)[ \t]+[A-Z][\w'’-]*|[ \t]+[A-Z][\w'’-]*)+\b",
    r"\b[a-z][a-z'’-]{7,}\b",
]


def batched(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = BATCH_CHARS) -> DataFrame:
    """(id, batch, chain, part, section_title, text): sections packed up to size, in the order of the text.

    Sections begin at Markdown headers. One of more than size characters is packed by its paragraphs into a chain of batches of its
    own, whose later parts carry the section's first line as section_title; every other batch is a chain by itself. Null and
    blank texts have no batches. Ids are taken to be distinct.
    """
    sections = packing.pieces(F.split(packing.unmarked(F.col(text_col)), f"(?m)(?={_HEADER})"))
    runs = F.split(packing.set_apart(sections, size, lambda s: F.concat(F.lit(packing.ALONE), s)), packing.BREAK)
    rows = docs.select(F.col(id_col), F.posexplode(F.filter(runs, lambda r: r != "")).alias("_run", "_text"))
    alone = F.col("_text").startswith(packing.ALONE)
    section = F.expr("substring(_text, 2)")
    paragraphs = F.array_join(packing.pieces(F.split(section, r"\n\n+|(?m)^---+$")), packing.LINES * 2)
    rows = rows.select(id_col, "_run", F.when(alone, packing.trimmed(F.substring_index(section, "\n", 1))).alias("_title"), F.posexplode(packing.packed(F.when(alone, paragraphs).otherwise(F.col("_text")), size)).alias("_part", "text"))
    title = F.when(F.col("_part") > 0, F.col("_title"))
    part = F.when(F.col("_title").isNotNull(), F.col("_part")).otherwise(0)
    order = Window.partitionBy(id_col).orderBy("_run", "_part")
    begun = F.sum(F.when(title.isNull(), 1).otherwise(0)).over(order)
    return rows.select(id_col, (F.row_number().over(order) - 1).alias("batch"), (begun - 1).cast("int").alias("chain"), part.alias("part"), title.alias("section_title"), "text")


def uncovered(text: str, records: list[dict], least: float = COVERAGE) -> list[dict]:
    """Sections of a batch of whose facts the records have too few: title, text, coverage, missing facts."""
    said = [x for r in records for x in (r["name"], *r["aliases"], *r["traits"], r["body"], *(k["text"] for k in r["keywords"]))]
    known, out = f" {normal(' '.join(said))} ", []
    for section in filter(None, (s.strip() for s in re.split(f"(?m)(?={_HEADER})", text))):
        facts = dict.fromkeys(next((g for g in m.groups() if g), m[0]).strip() for p in FACTS for m in re.finditer(p, section, re.M))
        missing = [f for f in facts if normal(f) not in known]
        if len(facts) >= LEAST_FACTS and (len(facts) - len(missing)) / len(facts) < least:
            title = re.sub(r"^#{1,6}\s+|\*+", "", section.split("\n", 1)[0].strip()).strip()
            out.append({"title": title, "text": section, "coverage": (len(facts) - len(missing)) / len(facts), "missing": missing[:NAMED_FACTS]})
    return out


def extracted(batches: DataFrame, extract: Callable, id_col: str = "doc_id", coverage: float | None = COVERAGE) -> DataFrame:
    """(id, chain, batch, pos, repaired, record, warning) of all chains: a record each, or what went wrong.

    extract(text, title, names, missing) gives records (dicts, or a model's answer as text). names are those that the chain has given so far, title
    is the section's in its later parts, and missing is empty but in a repair: a batch of whose facts the records have too few is
    asked about once more, with the sections in question. Records without a name or a body go. A call that fails is a
    warning and the chain goes on; a repair that fails or is not enough is a warning, and what was found stays. coverage None: no repairs.
    """
    kind = batches.schema[id_col].dataType.simpleString()

    def ask(*args) -> list[dict]:
        got = extract(*args)
        return [v for x in (parse_array(got) if isinstance(got, str) else got) if (v := validate(x))]

    def fold(frames):
        """Chains one behind the other, each in order; what a chain has given so far is kept over the ends of frames."""
        last, found = None, []
        for f in frames:
            rows = []

            def put(b, records: list[dict], repaired: bool) -> None:
                rows.extend((b.id, int(b.chain), int(b.batch), len(found) + i, repaired, r, None) for i, r in enumerate(records))
                found.extend(records)

            def warn(b, text: str) -> None:
                rows.append((b.id, int(b.chain), int(b.batch), len(found), False, None, text))

            for b in f.itertuples(index=False):
                if (b.id, b.chain) != last:
                    last, found = (b.id, b.chain), []
                try:
                    put(b, ask(b.text, b.section_title, [r["name"] for r in found], []), False)
                except Exception as e:  # noqa: BLE001 - a remote model may fail in any way
                    warn(b, f"failed: {e}")
                    continue
                low = uncovered(b.text, found, coverage) if coverage is not None else []
                if not low:
                    continue
                try:
                    put(b, ask("\n\n".join(s["text"] for s in low), b.section_title, [r["name"] for r in found], low), True)
                except Exception as e:  # noqa: BLE001
                    warn(b, f"repair failed: {e}")
                    continue
                still = uncovered(b.text, found, coverage)
                if still:
                    warn(b, "still under-captured: " + ", ".join(s["title"] for s in still))
            yield pd.DataFrame(rows, columns=["id", "chain", "batch", "pos", "repaired", "record", "warning"])

    # chains are dealt and sorted whole and streamed: a frame has many of them, where a group of its own for each costs more than its fold
    rows = batches.select(F.col(id_col).alias("id"), "chain", "batch", "part", "section_title", "text").repartition("id", "chain").sortWithinPartitions("id", "chain", "part")
    out = rows.mapInPandas(fold, f"id {kind}, chain int, batch int, pos int, repaired boolean, record {ENTITY}, warning string")
    return out.withColumnRenamed("id", id_col)


def verified(records: DataFrame, batches: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """records with name_grounded, ungrounded_aliases and ungrounded_keywords: what the batch they came from does not have."""
    rows = records.where("record IS NOT NULL").join(batches.select(id_col, "batch", F.col("text").alias("_source")), [id_col, "batch"])
    source = F.col("_source")
    return rows.withColumns({
        "name_grounded": grounded(F.col("record.name"), source, NAME_SLACK),
        "ungrounded_aliases": F.filter("record.aliases", lambda a: ~grounded(a, source, NAME_SLACK)),
        "ungrounded_keywords": F.filter(F.transform("record.keywords", lambda k: k["text"]), lambda k: ~grounded(k, source, KEYWORD_SLACK)),
    }).drop("_source")


def merged(records: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, place, record, copies): records of one document and type that share a name or an alias as one, in the order of the first.

    A document's records are few beside its text; they are joined in order, as each joins what those before have become.
    """
    kind = records.schema[id_col].dataType.simpleString()
    plain = lambda r: {k: [dict(x) if not isinstance(x, str) else x for x in v] if k in ("aliases", "traits", "relationships", "keywords") else v for k, v in dict(r).items()}

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out, copies = merge([plain(r) for r in rows.sort_values(["batch", "pos"])["record"]], counted=True)
        return pd.DataFrame({"id": key[0], "place": range(len(out)), "record": out, "copies": copies})

    rows = records.where("record IS NOT NULL").select(id_col, "batch", "pos", "record")
    return rows.groupBy(id_col).applyInPandas(fold, f"id {kind}, place int, record {ENTITY}, copies int").withColumnRenamed("id", id_col)


def linked(records: DataFrame, batches: DataFrame, link: Callable, id_col: str = "doc_id") -> DataFrame:
    """merged() records with the relationships that link(text, names) finds in any batch: triples (source, target, type).

    Both ends must be records of the document, by name or alias without case, and different; a target takes its record's name. A
    relationship that is there already is not added, and a batch that fails adds none.
    """
    kind = records.schema[id_col].dataType.simpleString()
    names = records.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.col("record.name").alias("n")))), lambda x: x["n"]).alias("names"))

    def ask(frames):
        for f in frames:
            rows = []
            for b in f.itertuples(index=False):
                try:
                    rows += [(b[0], b.batch, i, str(s).strip().lower(), str(t).strip().lower(), str(k).strip()) for i, (s, t, k) in enumerate(link(b.text, list(b.names)))]
                except Exception:  # noqa: BLE001, S110 - the records stay as they are
                    pass
            yield pd.DataFrame(rows, columns=["id", "batch", "i", "s", "t", "type"])

    triples = batches.join(names, id_col).select(id_col, "batch", "text", "names").mapInPandas(ask, f"id {kind}, batch int, i int, s string, t string, type string")
    keys = records.select(F.col(id_col).alias("id"), "place", F.col("record.name").alias("name"), F.explode(F.concat(F.array("record.name"), "record.aliases")).alias("key"))
    keys = keys.withColumn("key", F.lower(F.trim("key"))).groupBy("id", "key").agg(F.min_by(F.struct("place", "name"), "place").alias("r")).select("id", "key", "r.*")
    ends = lambda c, p: keys.select("id", F.col("key").alias(c), F.col("place").alias(f"{p}_place"), F.col("name").alias(f"{p}_name"))
    found = triples.join(ends("s", "s"), ["id", "s"]).join(ends("t", "t"), ["id", "t"]).where("s_place <> t_place")
    found = found.groupBy("id", "s_place", "t_name", "type").agg(F.min(F.struct("batch", "i")).alias("o"))
    more = found.groupBy("id", F.col("s_place").alias("place")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", F.struct(F.col("t_name").alias("target"), "type").alias("r")))), lambda x: x["r"]).alias("_more"))
    out = records.join(more.withColumnRenamed("id", id_col), [id_col, "place"], "left")
    key = lambda r: F.struct(F.lower(F.trim(r["target"])), F.lower(F.trim(r["type"])))
    have = F.transform("record.relationships", key)
    new = F.filter(F.coalesce("_more", F.array().cast("array<struct<target:string,type:string>>")), lambda r: ~F.array_contains(have, key(r)))
    return out.withColumn("record", F.col("record").withField("relationships", F.concat("record.relationships", new))).drop("_more")
