"""Secret scans with corpus-wide ownership.

Patterns find candidates in whole texts. The hash of each candidate's value is counted over all texts: by how many
repositories and by how many owners it is held. A value that many owners hold, or many of one owner's repositories, is a
copied example; another that few owners hold, with the entropy of a random string and no placeholder word in it, looks live.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from codecensus.llm.common import slices
from codecensus.llm.native import bounded
from codecensus.session import cut

#: Base kinds first, in the order in which equal starts are listed; then the kinds this method adds.
KINDS = ("assign", "access", "hex", "pem", "vendor", "jwt")
BASE = 3

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# Runs are maximal, so a run starts where no such character stands before it.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_PEM = re.compile(r"-----BEGIN [A-Z0-9 ]{0,30}PRIVATE KEY-----")
_VENDOR = re.compile(r"(?<![A-Za-z0-9_])(?:gh[posr]_[A-Za-z0-9]{30,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|[rs]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+")
_PLACEHOLDER = re.compile(r"example|sample|dummy|changeme|placeholder|your[_-]|xxxx|test", re.IGNORECASE | re.ASCII)


def candidates(text: str | None) -> list[tuple[int, int, int, str]]:
    """(kind number, start, end, value) of a whole text, by start, then kind; offsets in code points, end exclusive."""
    text = text or ""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(0, m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(1, m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text)]
    found += [(2, m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    for kind, mark, pattern in ((3, "-----BEGIN ", _PEM), (4, None, _VENDOR), (5, "eyJ", _JWT)):
        if mark is None or mark in text:
            found += [(kind, m.start(), m.end(), m[0]) for m in pattern.finditer(text)]
    return sorted(found, key=lambda c: (c[1], c[0]))


def entropy(value: str) -> float:
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) if n else 0.0


def _joined(spans: Column, *more: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), *[s[x].cast("string") for x in ("start", "stop", *more)])))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None, *,
                copied_owners: int = 3, live_owners: int = 1, min_entropy: float = 3.0, copied_repos: int = 10, copied_share: float = 0.001) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, live, held).

    A value is a copied example if ``copied_owners`` owners or more hold it, or if one owner holds it in ``copied_repos``
    repositories or more that are ``copied_share`` of the owner's repositories or more. ``spans`` lists the base spans
    and, of the added kinds, those that are no copied example; ``n_example`` counts copied examples. ``live`` lists other
    spans whose value at most ``live_owners`` owners hold and that look random. ``held`` lists all spans with the numbers
    of owners and of repositories that hold the value. A document is its own repository unless ``repo_col`` names one.
    Null and empty texts have no span; null owners are one owner; repeated rows give repeated rows and count as one
    repository. An empty table gives an empty result; other columns are ignored.
    """
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            out = []
            for text in batch["text"]:
                found = candidates(text)
                base = [f"{KINDS[k]}:{s}:{e}" for k, s, e, _ in found if k < BASE]
                n = Counter(k for k, *_ in found)
                out.append((n[0], n[1], n[2], hashlib.sha256(",".join(base).encode()).hexdigest(),
                            [{"start": s, "kind": k, "stop": e, "value": xxhash.xxh3_128_digest(v.encode("utf-8", "surrogatepass")),
                              "random": entropy(v) >= min_entropy and not _PLACEHOLDER.search(v)} for k, s, e, v in found]))
            facts = pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "base_sha256", "found"])
            yield pd.concat([batch[["row", "doc_id", "owner", "repo"]].reset_index(drop=True), facts], axis=1)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(owner_col).cast("string").alias("owner"),
                       F.col(repo_col or id_col).cast("string").alias("repo"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = cut(rows.mapInPandas(scan, f"row long, doc_id {kind}, owner string, repo string, n_assign long, n_access long, n_hex long, base_sha256 string, "
                                      "found array<struct<start: long, kind: int, stop: long, value: binary, random: boolean>>"))
    each = rows.select("row", "owner", "repo", F.explode("found").alias("f")).select("row", "owner", "repo", "f.*")
    totals = rows.select("owner", "repo").distinct().groupBy("owner").agg(F.count("*").alias("all_repos"))
    owners = each.select("value", "owner", "repo").distinct().groupBy("value", "owner").agg(F.count("*").alias("repos"))
    owners = owners.alias("o").join(bounded(cut(totals)).alias("t"), F.expr("o.owner <=> t.owner")).withColumn(
        "spread", (F.col("repos") >= copied_repos) & (F.col("repos") >= copied_share * F.col("all_repos")))
    owners = owners.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.max("spread").alias("spread"))
    owners = owners.select("value", "owners", "repos", ((F.col("owners") >= copied_owners) | F.col("spread")).alias("copied"))
    judged = each.join(owners, "value").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "stop", "random", "owners", "repos", "copied"))).alias("judged"))
    spans = F.col("judged")
    none = F.array().cast("array<struct<start: bigint, kind: int, stop: bigint, random: boolean, owners: bigint, repos: bigint, copied: boolean>>")
    out = rows.join(judged, "row", "left").withColumn("judged", F.coalesce("judged", none))
    live = F.filter(spans, lambda s: (s["owners"] <= live_owners) & ~s["copied"] & s["random"])
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", _joined(F.filter(spans, lambda s: (s["kind"] < BASE) | ~s["copied"])).alias("spans"),
        F.size(live).cast("long").alias("n_live"), F.size(F.filter(spans, lambda s: s["copied"])).cast("long").alias("n_example"), _joined(live).alias("live"),
        _joined(spans, "owners", "repos").alias("held"))
