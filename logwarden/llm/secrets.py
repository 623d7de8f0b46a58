"""Secret scans with corpus-wide ownership frequency.

Base patterns find secrets in each text. Besides, random-looking tokens are
candidates: the hashes of their values and of the base secrets are counted
over the corpus by distinct repositories and owners. A value that many owners
share is a copied example; one that a single owner has is live-looking, and
such tokens are added to the base spans.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fields, map_rows, stage

#: The base patterns, by kind in the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "owned")
OWNED = KINDS.index("owned")
SPAN = "struct<start:int,kind:int,end:int>"
FOUND = "struct<start:int,kind:int,end:int,hash:bigint>"
#: A value with more than one in so many of all spans is hot; so there are no more hot values than this.
HOT = 10_000
#: Rows with added spans up to this number are joined by broadcast.
BROADCAST_ROWS = 200_000

#: Without one of these in the lower-case text, ASSIGN has no match.
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
_MIXED = re.compile(r"(?=[^0-9]*[0-9])[0-9+/_-]*[A-Za-z]")


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, secret) by start, then kind. Runs of hex digits and of access key characters are maximal, so a length in their pattern drops the same matches as a check afterwards."""
    low = text.lower()
    out = []
    if any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    out.sort()
    return out


def entropy(token: str) -> float:
    """Bits per character."""
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def other_tokens(text: str, base: list[tuple[int, int, int, str]], least: float) -> list[tuple[int, int, str]]:
    """(start, end, token) of random-looking tokens with letters and digits that no base span touches."""
    out, at, reach = [], 0, 0
    for m in _TOKEN.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][2])
            at += 1
        t = m[0]
        if reach <= m.start() and _MIXED.match(t) and entropy(t) >= least:
            out.append((m.start(), m.end(), t))
    return out


def digest(value: str) -> int:
    """64 bits of a secret's SHA-256, signed; the value itself is never stored."""
    return int.from_bytes(hashlib.sha256(value.encode()).digest()[:8], "big", signed=True)


def _render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scanned(docs: DataFrame, keep: list[str], owner: str, repository: tuple[str, ...], least_entropy: float) -> DataFrame:
    """The columns in keep with base spans, found (these and candidates, with the hashes of their values), owner_ and repository_, and a number for each row; staged."""
    schema = fields(*[(c, docs.schema[c].dataType.simpleString()) for c in keep], ("base", f"array<{SPAN}>"), ("found", f"array<{FOUND}>"), ("owner_", "string"), ("repository_", "string"))
    named = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text_"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner_"), F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repository]).alias("repository_"))
    n_keep = len(keep)

    def run(batches):
        for rows in batches:
            for row in rows:
                text, own, repo = row[n_keep:]
                base = base_spans(text)
                found = [(s, k, e, digest(v)) for s, k, e, v in base] + [(s, OWNED, e, digest(v)) for s, e, v in other_tokens(text, base, least_entropy)]
                yield (*row[:n_keep], [{"start": s, "kind": k, "end": e} for s, k, e, _ in base], [{"start": s, "kind": k, "end": e, "hash": h} for s, k, e, h in found], own, repo)

    return stage(map_rows(named, run, schema).withColumn("row_", F.monotonically_increasing_id()), "secrets")


def _judged(scanned: DataFrame, max_owners: int, max_repositories: int) -> DataFrame:
    """row_, start, kind, end and live of each span and candidate.

    A value's owners and repositories are partial sums per (hash, owner,
    repository) before the shuffle. A value of more than one in HOT of all
    spans is hot; there are HOT of these at most, so they are broadcast, and
    only the others' spans are shuffled to their counts.
    """
    each = scanned.select("row_", "owner_", "repository_", F.explode("found").alias("f")).select("row_", "owner_", "repository_", "f.*")
    by_owner = each.groupBy("hash", "owner_", "repository_").agg(F.count("*").alias("n"))
    values = by_owner.groupBy("hash").agg(F.countDistinct("owner_").alias("owners"), F.countDistinct("repository_").alias("repositories"), F.sum("n").alias("n"))
    live = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    values = stage(values.select("hash", live.alias("live"), "n"), "secrets")
    total = values.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = values.where(F.col("n") * HOT > total).select("hash", F.col("live").alias("hot_live"))
    spans = each.select("row_", "start", "kind", "end", "hash").join(F.broadcast(hot), "hash", "left")
    others = spans.where("hot_live is null").drop("hot_live").join(values.select("hash", "live"), "hash")
    return spans.where("hot_live is not null").select("row_", "start", "kind", "end", F.col("hot_live").alias("live")).unionByName(others.select("row_", "start", "kind", "end", "live"))


def scan(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), max_owners: int = 1, max_repositories: int = 2, least_entropy: float = 3.0) -> DataFrame:
    """Secrets of every whole text.

    docs: doc_id, text, the owner column and the repository columns. Returns
    doc_id, base and spans (arrays of struct<start, kind, end>; code
    points, end exclusive; spans also hold the added ones), n_live and
    n_shared (base secrets whose value one owner, or several, have).
    Null text: as empty, no spans. A null owner or repository counts as one
    of its own, named by the empty string. Repeated rows are each kept.
    """
    scanned = _scanned(docs, ["doc_id"], owner, repository, least_entropy)
    per_row = _judged(scanned, max_owners, max_repositories).groupBy("row_").agg(
        F.collect_list(F.when((F.col("kind") == OWNED) & F.col("live"), F.struct("start", "kind", "end"))).alias("added"),
        F.sum(F.when((F.col("kind") < OWNED) & F.col("live"), 1).otherwise(0)).alias("n_live"),
        F.sum(F.when((F.col("kind") < OWNED) & ~F.col("live"), 1).otherwise(0)).alias("n_shared"),
    )
    out = scanned.join(per_row, "row_", "left")
    return out.select("doc_id", "base", _with_added("added").alias("spans"), F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"), F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared"))


def _with_added(added: str) -> Column:
    return F.array_sort(F.concat("base", F.coalesce(added, F.array().cast(f"array<{SPAN}>"))))


def rendered(spans: str) -> Column:
    """kind:start:end of the spans, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digests(docs: DataFrame) -> DataFrame:
    """The digest columns of every document's spans, from scan()."""
    got = scan(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return got.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(rendered("base"), 256).alias("base_sha256"), rendered("spans").alias("spans"), "n_live", "n_shared",
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), max_owners: int = 1, max_repositories: int = 2, least_entropy: float = 3.0) -> DataFrame:
    """docs with every span that scan() reports replaced by mark; texts without spans are unchanged. Overlapping spans are one. n_chars, if it is a column, is set anew where the text changes; null texts stay null. Names of columns may be any.

    Only rows with candidates wait for the counts, and their spans go to them:
    by broadcast up to a checked number, else these rows are shuffled.
    """
    names = docs.columns
    own = {c: f"in{i}_" if c != "text" else c for i, c in enumerate(names)}
    cols = list(own.values())
    scanned = _scanned(docs.select(*[F.col(f"`{c}`").alias(own[c]) for c in names]), cols, own[owner], tuple(own[c] for c in repository), least_entropy)
    waits = F.exists("found", lambda f: f["kind"] == OWNED)
    live = _judged(scanned, max_owners, max_repositories).where(F.col("live") & (F.col("kind") == OWNED))
    added = stage(live.groupBy("row_").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added")), "secrets")
    added = F.broadcast(added) if added.count() <= BROADCAST_ROWS else added
    later = scanned.where(waits).join(added, "row_", "left").select(*cols, _with_added("added").alias("spans"))
    got = scanned.where(~waits).select(*cols, F.col("base").alias("spans")).unionByName(later)
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for rows in batches:
            for *row, spans in rows:
                if spans:
                    text, out, last = row[at], [], 0
                    for s in spans:
                        if s["start"] >= last:
                            out += [text[last : s["start"]], mark]
                        last = max(last, s["end"])
                    row[at] = "".join(out) + text[last:]
                    if chars is not None:
                        row[chars] = len(row[at])
                yield tuple(row)

    changed = map_rows(got.where(F.size("spans") > 0), run, docs.schema)
    return got.where(F.size("spans") == 0).select(*[F.col(own[c]).alias(c) for c in names]).unionAll(changed)
