"""Entities and events from loosely formed JSON, glossaries, and the merge of entities."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: The vocabulary of entry types.
ENTRY_TYPES = ("character", "organization", "concept", "location", "item", "other")
TRAIT_CHARS, TRAITS, TRAIT_OVERLAP = 160, 15, 80
ENTITY = "struct<entry_type:string,name:string,aliases:array<string>,affiliation:string,traits:array<string>,relationships:array<struct<target:string,type:string>>,keywords:array<struct<text:string,importance:int>>,body:string>"
def batched(kind: str):
    """A function of a text column from one of a pandas series; the UDF is made at its first use, when there is a session."""

    def put(f):
        def call(column):
            return F.pandas_udf(f, kind)(column)

        call.__doc__ = f.__doc__
        return call

    return put


SMALL = {"a", "an", "the", "and", "or", "of", "for", "in", "on", "to", "at", "by", "with"}


def parse_array(text: str | None) -> list:
    """Objects from text that should be a JSON array: fenced, wrapped in an object, one a line, or loose among other words."""
    if not text:
        return []
    text = re.sub(r"^\s*```[a-zA-Z]*\s*|\s*```\s*$", "", text.strip())

    def objects(v) -> list:
        if isinstance(v, list):
            return [x for x in v if isinstance(x, dict)]
        if isinstance(v, dict):
            return next((objects(x) for x in v.values() if isinstance(x, list) and objects(x)), [v])
        return []

    try:
        return objects(json.loads(text))
    except ValueError:
        pass
    out, at, decoder = [], 0, json.JSONDecoder()
    while (at := min((i for i in (text.find("{", at), text.find("[", at)) if i >= 0), default=-1)) >= 0:
        try:
            v, end = decoder.raw_decode(text, at)
            out += objects(v)
            at = end
        except ValueError:
            at += 1
    return out


@batched("array<string>")
def json_objects(texts: pd.Series) -> pd.Series:
    """Each object of a text as JSON, in order."""
    return texts.map(lambda t: [json.dumps(x, ensure_ascii=False) for x in parse_array(t)])


def _text(v) -> str:
    if isinstance(v, str):
        return v.strip()
    if isinstance(v, dict):
        parts = list(dict.fromkeys(x for k in ("target", "name", "description", "relation", "type") if isinstance(x := v.get(k), str) and x.strip()))
        return " — ".join(parts).strip() or json.dumps(v, ensure_ascii=False)
    return "" if v is None else str(v).strip()


def normal(text: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]|_", " ", text.lower())).strip()


def validate(raw: dict) -> dict | None:
    """An entity of fixed form, or None without a name or a body."""
    name, body = (raw[k].strip() if isinstance(raw.get(k), str) else "" for k in ("name", "body"))
    if not name or not body:
        return None
    kind = _text(raw.get("entry_type")).lower()
    strings = lambda k: list(dict.fromkeys(t for t in map(_text, raw[k] if isinstance(raw.get(k), list) else []) if t))
    flat = normal(body)
    traits = [t for t in strings("traits") if len(t) <= TRAIT_CHARS and not (len(normal(t)) >= TRAIT_OVERLAP and normal(t) in flat)][:TRAITS]
    relations: dict[tuple, dict] = {}
    for r in raw["relationships"] if isinstance(raw.get("relationships"), list) else []:
        get = lambda *ks: next((r[k].strip() for k in ks if isinstance(r, dict) and isinstance(r.get(k), str) and r[k].strip()), "")
        target, link = (r.strip(), "") if isinstance(r, str) else (get("target", "name"), get("type", "relation", "relationship"))
        link = "subtopic of" if re.fullmatch(r"(?i)sub-?\s?topic\s+of", link) else link
        if target:
            relations.setdefault((target.lower(), link.lower()), {"target": target, "type": link})
    words: dict[str, dict] = {}
    for k in raw["keywords"] if isinstance(raw.get("keywords"), list) else []:
        t = _text(k if isinstance(k, str) else k.get("text") if isinstance(k, dict) else "")
        n = k.get("importance") if isinstance(k, dict) else 5
        n = n if isinstance(n, (int, float)) and not isinstance(n, bool) and n == n else 5
        if t:
            words.setdefault(t.lower(), {"text": t, "importance": int(max(1, min(10, n)) + 0.5)})
    return {"entry_type": kind if kind in ENTRY_TYPES else "other", "name": name, "aliases": strings("aliases"), "affiliation": _text(raw.get("affiliation")) if isinstance(raw.get("affiliation"), str) else "", "traits": traits, "relationships": list(relations.values()), "keywords": list(words.values()), "body": body}


@batched(f"array<{ENTITY}>")
def entities_of(texts: pd.Series) -> pd.Series:
    """The valid entities of a model's answer."""
    return texts.map(lambda t: [e for x in parse_array(t) if (e := validate(x))])


def union_strings(a: list[str], b: list[str]) -> list[str]:
    out: dict[str, str] = {}
    for s in [*a, *b]:
        out.setdefault(s.lower(), s)
    return list(out.values())


def merge_bodies(a: str, b: str) -> str:
    """The longer text, and what paragraphs (of a single one: sentences) of the other it does not have."""
    if not a or not b:
        return a or b
    out, rest = (b, a) if len(b) > len(a) else (a, b)
    flat = normal(out)
    parts = [p.strip() for p in re.split(r"\n\n+", rest) if p.strip()]
    for p in parts:
        pieces = [p] if len(parts) > 1 else [s.strip() for s in re.split(r"(?<=[.!?。！？])\s+", p) if s.strip()]
        new = " ".join(s for s in pieces if normal(s) and normal(s) not in flat)
        if new:
            out, flat = f"{out}\n\n{new}", f"{flat} {normal(new)}"
    return out


def merge(entities: list[dict], counted: bool = False):
    """Entities of one type that share a name or an alias, without case, are one, in the order of the first; bodies lose nothing.

    counted: with the number of entities behind each.
    """
    out: list[dict] = []
    copies: list[int] = []
    place: dict[tuple[str, str], int] = {}
    low = lambda s: s.strip().lower()
    for e in entities:
        keys = [(e["entry_type"], low(n)) for n in [e["name"], *e["aliases"]] if low(n)]
        at = next((place[k] for k in keys if k in place), len(out))
        if at == len(out):
            out.append({**e})
            copies.append(1)
        else:
            same = out[at]
            extra = [e["name"]] if low(e["name"]) != low(same["name"]) else []
            same["aliases"] = [a for a in union_strings(same["aliases"], [*extra, *e["aliases"]]) if low(a) != low(same["name"])]
            same["traits"] = union_strings(same["traits"], e["traits"])
            same["affiliation"] = same["affiliation"] or e["affiliation"]
            links: dict[tuple[str, str], dict] = {}
            for r in [*same["relationships"], *e["relationships"]]:
                links.setdefault((low(r["target"]), low(r["type"])), r)
            same["relationships"] = list(links.values())
            best: dict[str, dict] = {}
            for k in [*same["keywords"], *e["keywords"]]:
                if low(k["text"]) not in best or k["importance"] > best[low(k["text"])]["importance"]:
                    best[low(k["text"])] = k
            same["keywords"] = list(best.values())
            same["body"] = merge_bodies(same["body"], e["body"])
            copies[at] += 1
        place.update({k: at for k in keys})
    return (out, copies) if counted else out


@batched(f"array<{ENTITY}>")
def merged_entities(lists: pd.Series) -> pd.Series:
    plain = lambda e: {k: [dict(x) if not isinstance(x, str) else x for x in v] if k in ("aliases", "traits", "relationships", "keywords") else v for k, v in dict(e).items()}
    return lists.map(lambda es: merge([plain(e) for e in es]) if es is not None else [])


def relational_text(body: Column, affiliation: Column, relationships: Column) -> Column:
    """The body with a sentence each for affiliation and relationships."""
    parts = F.transform(relationships, lambda r: F.when(r["type"] != "", F.concat(r["type"], F.lit(" "), r["target"])).otherwise(r["target"]))
    return F.concat_ws("\n", body, F.when(affiliation != "", F.concat(F.lit("Affiliation: "), affiliation)), F.when(F.size(parts) > 0, F.concat(F.lit("Relationships: "), F.array_join(parts, "; "))))


def grounded(name: Column, source: Column, slack: float = 0.2) -> Column:
    """Whether the source has the name, or a run of as many words within slack * length edits of it."""
    flat = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\w\s]", " "), r"\s+", " "))
    words, n = F.split(flat(source), " "), F.size(F.split(flat(name), " "))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - n + 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
    return flat(source).contains(flat(name)) | F.exists(runs, lambda r: F.levenshtein(r, flat(name)) <= F.floor(slack * F.length(flat(name))))


def glossary(text: str | None) -> list[dict]:
    """Full Name (ACR) definitions whose initials are the acronym, with or without small words; the first of each acronym."""
    out: dict[str, str] = {}
    for m in re.finditer(r"((?:[A-Z][\w'-]*|(?:of|the|and|for|in|on|to|a|an|at|by|with|or))(?:\s+(?:[A-Z][\w'-]*|of|the|and|for|in|on|to|a|an|at|by|with|or))*)\s*\(([A-Z][A-Z0-9]{1,9})\)", text or ""):
        words, acronym = m[1].split(), m[2]
        for k in range(len(words)):
            rest = words[k:]
            if rest[0] in SMALL:  # a name does not begin with a small word in lower case
                continue
            if acronym in ("".join(w[0].upper() for w in rest), "".join(w[0].upper() for w in rest if w.lower() not in SMALL)):
                out.setdefault(acronym, " ".join(rest))
                break
    return [{"acronym": a, "full_name": f} for a, f in out.items()]


@batched("array<struct<acronym:string,full_name:string>>")
def glossary_of(texts: pd.Series) -> pd.Series:
    return texts.map(glossary)


def fact_coverage(sections: DataFrame, output: Column, text: Column, least_tokens: int = 3, least: float = 0.5) -> DataFrame:
    """Each section's share of names and numbers that the output has; sections of few are left out, low ones flagged."""
    facts = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(?:[A-Z][a-z]{2,}|\d[\d.,]*)\b"), F.lit(0)))
    hit = F.filter(facts, lambda t: F.contains(F.lower(output), F.lower(t)))
    return sections.withColumns({"facts": F.size(facts), "covered": F.size(hit)}).where(F.col("facts") >= least_tokens).withColumn("coverage", F.col("covered") / F.col("facts")).withColumn("low", F.col("coverage") < least)
