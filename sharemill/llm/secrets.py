"""Multipart credential linking. Strong spans stand by themselves; weak candidates (key-like strings,
account names, endpoints) are reported only where the parts that complete them lie within the
same scope, which an interval join finds. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import columns_of, materialize, unused

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: The least lengths of an assigned value, an access identifier and a hexadecimal run.
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Weak candidates: 40 key characters, a named account, an endpoint.
KEY = r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
ACCOUNT = r"""(?i:user|username|login|account|client_id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
ENDPOINT = r"""(?i:https?|postgres|mysql|redis|amqp|s3)://[A-Za-z0-9@:%._/?&=+-]+"""
KINDS = ["assign", "access", "hex", "key", "account", "endpoint"]
#: What each kind is part of a credential as.
ROLE = {"assign": "secret", "hex": "secret", "key": "secret", "access": "id", "account": "id", "endpoint": "endpoint"}
#: The roles that must all lie within a weak candidate's scope.
NEEDS = {"key": ["id"], "account": ["secret"], "endpoint": ["id", "secret"]}
#: Code points between the end of one part and the start of the next, at most, in one scope.
SCOPE = 256
SPAN = "struct<start: int, stop: int, kind: string>"


def spans(text: Column, pattern: str, kind: str, keep) -> Column:
    """Non-overlapping matches from the left as structs of code points. A match starts after the
    text between matches so far and those matches, so lengths alone give its place."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    both = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: F.struct(h.alias("h"), F.length(g).alias("g")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        lo = acc["at"] + x["g"]
        hi = lo + F.length(x["h"])
        own = F.array(F.struct(lo.cast("int").alias("start"), hi.cast("int").alias("stop"), F.lit(kind).alias("kind")))
        return F.struct(hi.cast("int").alias("at"), F.when(keep(x["h"]), F.concat(acc["found"], own)).otherwise(acc["found"]).alias("found"))

    return F.aggregate(both, start, step, lambda acc: acc["found"])


def value_length(hit: Column) -> Column:
    return F.length(F.regexp_extract(hit, ASSIGN, 2))


def found_in(text: Column) -> dict[str, Column]:
    """The spans of each kind; a text without a trace of a kind isn't searched for its places."""
    long_hex = HEX.replace("+", f"{{{LEAST['hex']},}}")  # runs are maximal, so shorter ones just drop out
    empty = F.array().cast(f"array<{SPAN}>")
    every = {
        "assign": (ASSIGN, lambda h: value_length(h) >= LEAST["assign"]),
        "access": (ACCESS, lambda h: F.length(h) >= LEAST["access"]),
        "hex": (long_hex, lambda h: F.lit(True)),
        "key": (KEY, lambda h: h.rlike("[0-9]") & h.rlike("[a-z]") & h.rlike("[A-Z]")),
        "account": (ACCOUNT, lambda h: F.lit(True)),
        "endpoint": (ENDPOINT, lambda h: F.lit(True)),
    }
    return {k: F.when(text.rlike(p), spans(text, p, k, keep)).otherwise(empty) for k, (p, keep) in every.items()}


def in_order(all_spans: Column) -> Column:
    """By start, then kind as listed."""
    rank = F.create_map(*(F.lit(x) for k, kind in enumerate(KINDS) for x in (kind, k)))
    keyed = F.transform(all_spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    return F.array_sort(keyed)


def joined(ordered: Column) -> Column:
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def linked(weak: DataFrame, parts: DataFrame) -> DataFrame:
    """The weak spans (key, start, stop, kind) all of whose needed roles lie within SCOPE of them,
    end to start, by an interval join: a weak span is put in every bin of SCOPE code points that it
    covers, a part in every bin that it reaches, and a semi-join on document and bin compares places.
    It never makes a row for a pair; a long span makes a row for each bin."""
    role = F.create_map(*(F.lit(x) for k, r in ROLE.items() for x in (k, r)))
    p = parts.select(F.col("key").alias("p_key"), F.col("start").alias("p_start"), F.col("stop").alias("p_stop"), role[F.col("kind")].alias("role"))
    p = p.withColumn("p_bin", F.explode(F.expr(f"sequence((p_start div {SCOPE}) - 1, (p_stop div {SCOPE}) + 1)")))
    gap = F.greatest("start", "p_start") - F.least("stop", "p_stop")
    out = None
    for kind, roles in NEEDS.items():
        own = weak.where(F.col("kind") == kind)
        for r in roles:
            other = p.where(F.col("role") == r)
            binned = own.withColumn("bin", F.explode(F.expr(f"sequence(start div {SCOPE}, stop div {SCOPE})")))
            own = binned.join(other, (binned.key == other.p_key) & (binned.bin == other.p_bin) & (gap <= SCOPE), "left_semi").drop("bin").distinct()
        out = own if out is None else out.union(own)
    return out


def digest(doc_id: Column, text: Column) -> Column:
    """Names a document: rows of one id and text share it, no others do."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), text).cast("binary"))


def scan(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, key, base array, weak array; key names equal documents'
    ids and texts alike. Written to the shared folder: it is small, and read twice."""
    text = F.coalesce(F.col("text"), F.lit(""))
    f = found_in(F.col("t"))
    own = docs.select(F.col("doc_id").cast("long"), text.alias("t")).select(
        "doc_id", digest(F.col("doc_id"), F.col("t")).alias("key"), F.concat(f["assign"], f["access"], f["hex"]).alias("base"), F.concat(f["key"], f["account"], f["endpoint"]).alias("weak")
    )
    return materialize(own, "spans")


def find_secrets(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_assign, n_access, n_hex, base_sha256, spans. One row per input row: null texts are empty, repeated rows repeat, null
    ids stay, an empty table gives no rows, extra columns are ignored."""
    own = scan(docs)
    parts = own.where((F.size("weak") > 0)).select("key", F.explode(F.array_distinct(F.concat("base", "weak"))).alias("s")).select("key", "s.*").distinct()
    weak = parts.where(F.col("kind").isin(*NEEDS))
    more = linked(weak, parts).groupBy("key").agg(F.collect_set(F.struct("start", "stop", "kind")).alias("more"))
    base = in_order(F.col("base"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    whole = own.join(more, "key", "left")
    every = in_order(F.concat("base", F.coalesce("more", F.array().cast(f"array<{SPAN}>"))))
    return whole.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(every).alias("spans"))


#: Documents with linked spans up to which their table is broadcast.
MOST_LINKED = 100_000
MARK = "[secret]"


def merged(ordered: Column) -> Column:
    """Spans in order, with those that overlap made one."""
    one = lambda a, b: F.array(F.struct(a.alias("start"), b.alias("stop")))

    def step(acc: Column, s: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        meets = (F.size(acc) > 0) & (s["start"] < last["stop"])
        return F.when(meets, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), one(last["start"], F.greatest(last["stop"], s["stop"])))).otherwise(F.concat(acc, one(s["start"], s["stop"])))

    return F.aggregate(ordered, F.array().cast("array<struct<start: int, stop: int>>"), step)


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span of find_secrets() in text replaced by MARK, and n_chars following where
    there is such a column. Every row stays; null texts stay null."""
    f = found_in(F.col("text"))
    base = lambda: F.concat(f["assign"], f["access"], f["hex"])
    weak = F.concat(f["key"], f["account"], f["endpoint"])
    key = digest(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")))
    none = F.array().cast(f"array<{SPAN}>")
    parts = materialize(docs.select(key.alias("key"), F.explode(F.when(F.size(weak) > 0, F.concat(base(), weak)).otherwise(none)).alias("s")).select("key", "s.*").distinct(), "parts")
    k, b, m, t = (unused(n, docs.columns) for n in ("key", "base", "more", "redacted"))
    more = linked(parts.where(F.col("kind").isin(*NEEDS)), parts).groupBy("key").agg(F.collect_set(F.struct("start", "stop", "kind")).alias(m)).withColumnRenamed("key", k)
    more = materialize(more, "linked")
    few = F.broadcast(more) if more.count() <= MOST_LINKED else more
    own = docs.select("*", key.alias(k), base().alias(b)).join(few, k, "left")
    own = own.withColumn(b, merged(in_order(F.concat(F.coalesce(b, none), F.coalesce(m, none)))))
    stops = F.concat(F.array(F.lit(0)), F.col(f"{b}.stop"))
    starts = F.concat(F.col(f"{b}.start"), F.array(F.length("text")))
    gaps = F.zip_with(stops, starts, lambda lo, hi: F.col("text").substr(lo + 1, hi - lo))
    own = own.withColumn(t, F.when(F.size(b) > 0, F.array_join(gaps, MARK)).otherwise(F.col("text")))
    new = {"text": F.col(t)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size(b) > 0, F.length(t).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return own.select(*(new[c].alias(c) if c in new else col for c, col in zip(docs.columns, columns_of(docs), strict=True)))
