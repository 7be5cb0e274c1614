"""Personal data: base patterns, and identifiers that bootstrapped contexts add.

Base spans come from fixed patterns (KINDS). They are the seeds of a pattern-instance graph: an instance is an identifier's string, a
pattern the words around it (the two before; or the one before and the one after). Identifier-like strings that no base pattern takes are
candidates. Spark scores the graph in turns: a pattern is worth the share of its instances that are known to be of one kind, where an
instance of another kind counts against it in full and an unknown one by UNKNOWN; an instance is worth what its patterns are
together. Patterns with at least SUPPORT seeds and CONFIDENCE pass their kind on to candidates (tokens with an @ or at least DIGITS
digits), whose other contexts can then qualify too. All mentions of an accepted instance become spans.

Defined cases: null counts as the empty text, which has no spans; texts may be of any length, all patterns take linear time; rows that
repeat are found alike (distinct instances, not mentions, count in the graph); spans of one kind never overlap, those of different kinds
may, an added span overlaps no base span; one doc_id (or none) may stand over several texts, whose spans are kept apart; an empty table gives an empty result; other columns stay unread.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytestrata.llm.common import bounded_batches, cut, discard, rows_udf, table

KINDS = ("email", "ip", "card", "phone")
SUPPORT, CONFIDENCE, UNKNOWN, TURNS = 5, 0.8, 0.25, 3
#: Digits of a candidate; characters around a mention in which its context words lie.
DIGITS, AROUND = 7, 80
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile("[0-9@]")
_TOKEN = re.compile(r"\S+")
_EDGE = ".,;:!?()[]{}<>\"'*%$#&|"


def emails(text: str) -> list[tuple[int, int]]:
    """Every match begins with the whole run of local characters before its @, so the runs are looked for, not each start."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", m.end() if m else at + 1)
    return out


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(number of the kind, start, end), sorted."""
    if not _ANY.search(text):
        return []
    out = [(0, a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.groups()):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append((3, *m.span()))
    return out


def contexts(text: str, start: int, end: int) -> list[str]:
    """The patterns around a span."""
    before = text[max(0, start - AROUND) : start].lower().split()
    if start > AROUND and before and not text[start - AROUND - 1].isspace():
        before = before[1:]  # it may be a part of a word
    after = text[end : end + AROUND].lower().split()
    left = before[-1].strip("*%$#&|!") if before else ""
    out = [f"2 {before[-2]} {left}"] if len(before) > 1 and left else []
    return out + ([f"1 {left} _ {after[0]}"] if left and after else [])


def mentions(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str, list[str]]]:
    """(kind or -1, start, end, instance, patterns) of base spans and candidates."""
    if not _ANY.search(text):
        return []
    out = [(k, a, b, text[a:b], contexts(text, a, b)) for k, a, b in spans]
    taken = sorted((a, b) for _, a, b in spans)
    at = 0
    for m in _TOKEN.finditer(text):
        token = m[0]
        if "@" not in token and len(_digits(token)) < DIGITS:
            continue
        core = token.strip(_EDGE)
        if len(core) < DIGITS:
            continue
        a = m.start() + token.index(core)
        b = a + len(core)
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if not any(x < b and y > a for x, y in taken[at : at + 8]):
            out.append((-1, a, b, core, contexts(text, a, b)))
    return out


_SPAN = "array<struct<kind:int,start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))


def _structs(spans) -> list[dict[str, int]]:
    return [{"kind": k, "start": a, "end": b} for k, a, b in spans]


def text_key() -> Column:
    """Tells the texts of one doc_id apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def find_mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, base, mentions) of every whole text, each scanned once: mentions are seeds and candidates (kind -1)."""
    bounded_batches(docs.sparkSession)

    def f(doc_id: list, text_key: list, text: list) -> dict:
        base, found = [], []
        for t in text:
            own = base_spans(t or "")
            base.append(_structs(own))
            found.append([dict(zip(("kind", "start", "end", "instance", "patterns"), x, strict=True)) for x in mentions(t or "", own)])
        return {"doc_id": doc_id, "text_key": text_key, "base": base, "mentions": found}

    mention = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("base", _SPANS), ("mentions", pa.list_(mention))])
    ddl = f"doc_id long, text_key long, base {_SPAN}, mentions array<struct<kind:int,start:long,end:long,instance:string,patterns:array<string>>>"
    return docs.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(rows_udf(["doc_id", "text_key", "text"], schema, f), ddl)


def accepted_instances(found: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(instance, kind) of candidates that the graph's patterns vouch for; found: the mentions, a row each."""
    edges = cut(found.select("instance", "kind", F.explode("patterns").alias("pattern")).distinct())
    size = edges.groupBy("pattern").agg(F.countDistinct("instance").alias("n"), F.countDistinct(F.when(F.col("kind") >= 0, F.col("instance"))).alias("seeds"))
    against = F.col("seeds") + UNKNOWN * (F.col("n") - F.col("seeds"))  # what all instances weigh while the candidates are unknown
    size = cut(size.filter(F.col("seeds") >= support).withColumn("weight", against))
    seeds = edges.filter("kind >= 0").select("instance", "kind").distinct().withColumn("score", F.lit(1.0))
    useful = cut(edges.join(size.select("pattern"), "pattern", "left_semi"))
    open_ = useful.filter("kind < 0").select("pattern", "instance").distinct()
    scores, accepted = seeds, seeds.limit(0).select("instance", "kind")
    for _ in range(TURNS):
        mass = useful.select("pattern", "instance").distinct().join(scores, "instance").groupBy("pattern", "kind")
        mass = mass.agg(F.sum("score").alias("mass"), F.sum((F.col("score") >= 1).cast("int")).alias("support"))
        worth = mass.join(size, "pattern").withColumn("worth", F.col("mass") / (F.greatest("weight", "mass") + 1)).filter((F.col("worth") >= confidence) & (F.col("support") >= support))
        reached = open_.join(worth.select("pattern", "kind", "worth"), "pattern").groupBy("instance", "kind")
        reached = reached.agg((1 - F.exp(F.sum(F.log(1 - F.col("worth"))))).alias("score"))
        best = reached.groupBy("instance").agg(F.max(F.struct("score", (-F.col("kind")).alias("minus"))).alias("best"))
        now = cut(best.select("instance", (-F.col("best.minus")).cast("int").alias("kind"), F.col("best.score").alias("score")).filter(F.col("score") >= confidence))
        accepted = now.select("instance", "kind")
        if now.isEmpty():
            break
        scores = seeds.unionByName(now.withColumn("score", F.least("score", F.lit(0.999))))
    return accepted


def added_spans(found: DataFrame) -> DataFrame:
    """(doc_id, text_key, added): spans of accepted instances; found: what find_mentions wrote."""
    rows = found.select("doc_id", "text_key", F.explode("mentions").alias("m")).select("doc_id", "text_key", "m.*")
    new = rows.filter("kind < 0").drop("kind").join(accepted_instances(rows), "instance")
    span = F.struct(F.col("kind"), F.col("start"), F.col("end"))
    return new.groupBy("doc_id", "text_key").agg(F.collect_set(span).alias("added"))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): arrays of (kind, start, end), sorted by kind and start; spans holds base and what the method adds."""
    found = cut(find_mentions(docs))
    added = cut(added_spans(found))
    both = found.join(added, found["doc_id"].eqNullSafe(added["doc_id"]) & (found["text_key"] == added["text_key"]), "left")
    return both.select(found["doc_id"], "base", F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(_SPAN)))).alias("spans"))


def _joined(spans: str) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def mask(docs: DataFrame) -> DataFrame:
    """docs with each span's text replaced by its kind in brackets and n_chars following, where docs has it; null texts stay null."""
    bounded_batches(docs.sparkSession)
    columns, schema, name = docs.columns, docs.schema, "__added"
    while {name, name + "_of", name + "_key"} & set(columns):
        name += "_"
    found = cut(find_mentions(docs).select("doc_id", "text_key", "mentions").filter(F.size("mentions") > 0))
    added = cut(added_spans(found))
    discard(found)
    if added.isEmpty():
        rows = docs.withColumn(name, F.lit(None).cast(_SPAN))
    else:
        own = added.select(F.col("doc_id").alias(name + "_of"), F.col("text_key").alias(name + "_key"), F.col("added").alias(name))
        rows = docs.join(own, docs["doc_id"].eqNullSafe(own[name + "_of"]) & (text_key() == own[name + "_key"]), "left").select(*(docs[c] for c in columns), own[name])

    def run(batches):
        for b in batches:
            text, count = [], []
            for t, more in zip(b.column("text").to_pylist(), b.column(name).to_pylist(), strict=True):
                if t is not None:
                    spans = sorted([(a, z, k) for k, a, z in base_spans(t)] + [(x["start"], x["end"], x["kind"]) for x in more or ()])
                    parts, at = [], 0
                    for a, z, k in spans:
                        if a >= at:
                            parts += (t[at:a], f"[{KINDS[k].upper()}]")
                        at = max(at, z)
                    t = "".join((*parts, t[at:])) if spans else t
                text.append(t)
                count.append(None if t is None else len(t))
            own = {"text": pa.array(text, pa.string()), "n_chars": pa.array(count, pa.int64())}
            yield pa.RecordBatch.from_arrays([own[c] if c == "text" or c == "n_chars" and schema[c].dataType.simpleString() == "bigint" else b.column(c) for c in columns], columns)

    return rows.mapInArrow(run, schema)


def _count(kind: int) -> Column:
    """n_<kind>: how many base spans are of a kind. A second parameter of the lambda would be the span's place in the array."""
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, base counts n_email, n_ip, n_card and n_phone, base_sha256, spans of every document."""
    found = find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *map(_count, range(len(KINDS))), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
