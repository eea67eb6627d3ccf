"""Personal data by candidate gradient boosting.

Generators with high recall propose overlapping spans in whole texts. Each span is described by its format and by what
stands around it; boosted trees estimate how likely it is personal data, and a threshold calibrated for each kind on the
spans of all held-out documents decides. The trees learn from a bounded sample of the other documents, dealt out evenly by
kind and document: a span is a positive if the strict format check of
its kind accepts it (Luhn sum, octets, top-level domain, digit count), or if it is such a span written another way where
it stands (``written_otherwise``: ``[at]``, dots, slashes, other prefixes), which no strict check accepts. Negatives are
the loose spans of the texts themselves, and addresses whose host has lost its dots. The checks are no features, so that spans
that look alike but are mistyped or written another way are found as well. Spans that pass a strict check always stay.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from codecensus.llm.common import slices
from codecensus.session import cut

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE_EMAIL = re.compile(r"[^\s@<>(),;:\"']{1,64}(?:@|\x20?\[at\]\x20?|\x20?\(at\)\x20?)[^\s@<>(),;:\"']{2,255}")
_LOOSE_IP = re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\))[0-9]{1,3}){3}(?![0-9])")
_LOOSE_CARD = re.compile(r"(?<![0-9])[0-9]{4}(?:[./_][0-9]{4}){2}[./_][0-9]{1,7}(?![0-9])")
_LOOSE_CALL = re.compile(r"(?<![\w.])(?:\+|00)?\(?[0-9][0-9().\x20/-]{7,22}[0-9](?!\w)")
_CONTEXT = re.compile(r"mail|contact|write|phone|tel|call|fax|mobile|card|visa|credit|account|iban|ip|host|addr", re.IGNORECASE)

FEATURES = ("is_email", "is_ip", "is_card", "is_phone", "length", "digits", "letters", "separators", "groups", "longest_group", "starts_plus", "brackets",
            "word_before", "word_after", "keyword", "dots", "at_sign")
#: Documents whose spans the trees may learn from, and spans of these, a fourth of them for each kind; spans of a kind from one document.
SAMPLE_DOCUMENTS, SAMPLE_SPANS = 3000, 4000
DOCUMENT_SPANS = 4
PRECISION, RECALL, LEAST = 0.9, 0.95, 0.6
#: Characters on both sides of a span that is written another way; features look no farther.
AROUND = 40


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the strict kinds; leftmost matches that do not overlap within a kind."""
    found = []
    end = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((start, 0, m.end()))
            end = m.end()
        at = m.end() if m else at + 1
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(int(x[-400:]) <= 255 and len(x.lstrip("0")) <= 3 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdecimal, m[0])) <= 15]
    return sorted(found)


def loose_spans(text: str) -> list[tuple[int, int, int]]:
    """Overlapping proposals of the generators, strict spans among them."""
    found = set()
    if "@" in text or "at]" in text or "at)" in text:
        found |= {(m.start(), 0, m.end()) for m in _LOOSE_EMAIL.finditer(text)}
    found |= {(m.start(), 1, m.end()) for m in _IP.finditer(text)}
    if "[.]" in text or "(.)" in text:
        found |= {(m.start(), 1, m.end()) for m in _LOOSE_IP.finditer(text)}
    found |= {(m.start(), 2, m.end()) for m in _LOOSE_CARD.finditer(text)}
    found |= {(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 11 <= sum(map(str.isdecimal, m[0])) <= 20}
    found |= {(m.start(), 3, m.end()) for m in _LOOSE_CALL.finditer(text) if 9 <= sum(map(str.isdecimal, m[0])) <= 15}
    return sorted(found)


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    span = text[start:end]
    groups = re.findall(r"[0-9]+", span)
    before, after = text[start - 1 : start], text[end : end + 1]
    return [float(x) for x in (
        *(kind == k for k in range(4)), end - start, sum(map(len, groups)), sum(map(str.isalpha, span)), sum(c in " .-/" for c in span), len(groups),
        max(map(len, groups), default=0), span.startswith("+"), "(" in span, before.isalnum(), after.isalnum(), bool(_CONTEXT.search(text, max(0, start - 30), start)), span.count("."), "@" in span)]


def written_otherwise(span: str, kind: int) -> list[tuple[str, bool]]:
    """Forms of a strict span that no strict check accepts, and whether they still are personal data; the span itself
    decides which of several ways is taken."""
    dice = zlib.crc32(span.encode())
    if kind == 0:
        name, host = span.split("@")
        at = (" [at] ", "[at]", " (at) ", "(at)")[dice % 4]
        return [(name + at + host, True), (name + (at, "@")[dice // 4 % 2] + host.replace(".", ""), False)]
    if kind == 1:
        return [(("[.]", "(.)")[dice % 2].join(span.split(".")), True)]
    if kind == 2:
        digits = re.sub("[^0-9]", "", span)
        return [("./_"[dice % 3].join(digits[k : k + 4] for k in range(0, len(digits), 4)), True)]
    return [(("00" + span[1:], "00 " + span[1:], "00" + re.sub(r"[^0-9]+", "/", span[1:]))[dice % 3], True)]


def planted(text: str, start: int, kind: int, end: int) -> list[tuple[bool, list[float]]]:
    """(label, features) of a strict span written otherwise in its place, as the generators would propose it."""
    out = []
    for form, good in written_otherwise(text[start:end], kind):
        lead = text[max(0, start - AROUND) : start]
        window = lead + form + text[end : end + AROUND]
        strict = set(base_spans(window))
        shared = lambda x: min(x[2], len(lead) + len(form)) - max(x[0], len(lead))  # noqa: E731, B023
        near = [x for x in loose_spans(window) if x[1] == kind and x not in strict and shared(x) > 0]
        if near:
            out.append((good, features(window, *max(near, key=shared))))
    return out


def proposals(docs: DataFrame) -> DataFrame:
    """(row, doc_id, counts, base_sha256, found) of (row, doc_id, text); found: spans with label and
    features; planted ones are for learning only."""
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            out = []
            for text in batch["text"]:
                text = text or ""
                base = base_spans(text)
                strict = set(base)
                count = [sum(k == n for _, k, _ in base) for n in range(4)]
                said = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
                spans = [{"start": s, "kind": k, "stop": e, "strict": (s, k, e) in strict, "planted": False, "label": float((s, k, e) in strict), "features": features(text, s, k, e)}
                         for s, k, e in sorted({*base, *loose_spans(text)})]
                spans += [{"start": s, "kind": k, "stop": e, "strict": False, "planted": True, "label": float(good), "features": x} for s, k, e in base for good, x in planted(text, s, k, e)]
                out.append((*count, hashlib.sha256(said.encode()).hexdigest(), spans))
            facts = pd.DataFrame(out, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "found"])
            yield pd.concat([batch[["row", "doc_id"]].reset_index(drop=True), facts], axis=1)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInPandas(scan, f"row long, doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
                                  "found array<struct<start: long, kind: int, stop: long, strict: boolean, planted: boolean, label: double, features: array<double>>>")


def _vectors(spans: DataFrame) -> DataFrame:
    named = spans.select("*", *[F.get("features", k).alias(n) for k, n in enumerate(FEATURES)])
    return VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(named).drop(*FEATURES)


def _chance(model: GBTClassificationModel, spans: DataFrame) -> DataFrame:
    return model.transform(_vectors(spans)).withColumn("chance", vector_to_array("probability")[1]).drop("vector", "rawPrediction", "probability", "prediction")


def fitting_sample(rows: DataFrame) -> DataFrame:
    """(kind, strict, features, label) of a bounded sample of (dice, found): for each kind the same number of documents, and of
    these first one span each, then the next. Equal dice are one document."""
    def some(kind: int) -> Column:
        dealt = F.array_sort(F.transform(F.filter("found", lambda f: f["kind"] == kind), lambda f: F.struct(F.xxhash64(f["start"], f["stop"], f["planted"], f["label"]).alias("order"), f.alias("f"))))
        return F.struct(F.lit(kind).alias("kind"), F.slice(dealt, 1, DOCUMENT_SPANS).alias("some"))

    of_kind = rows.select("dice", F.explode(F.array(*[some(k) for k in range(len(KINDS))])).alias("x")).select("dice", "x.*").where(F.size("some") > 0)
    most = SAMPLE_DOCUMENTS // len(KINDS)
    # Thinned by hash to about twice the number, so that what meets in one place does not grow with the corpus.
    shares = {r["kind"]: min(1.0, 2 * most / r["n"]) for r in of_kind.groupBy("kind").agg(F.count_distinct("dice").alias("n")).collect()}
    if not shares:
        return of_kind.select("kind", F.lit(True).alias("strict"), F.array(F.lit(0.0)).alias("features"), F.lit(0.0).alias("label")).limit(0)
    share = F.create_map(*[x for k, v in shares.items() for x in (F.lit(k), F.lit(v))])
    thin = of_kind.where(F.pmod(F.xxhash64("dice"), F.lit(1 << 31)) < F.try_element_at(share, F.col("kind")) * (1 << 31)).dropDuplicates(["kind", "dice"])
    chosen = thin.withColumn("n", F.row_number().over(Window.partitionBy("kind").orderBy("dice"))).where(F.col("n") <= most)
    spans = chosen.select("dice", "kind", F.posexplode("some").alias("nth", "x")).withColumn(
        "n", F.row_number().over(Window.partitionBy("kind").orderBy("nth", "dice"))).where(F.col("n") <= SAMPLE_SPANS // len(KINDS))
    return spans.orderBy("kind", "n").select("kind", "x.f.strict", "x.f.features", "x.f.label")


def train(rows: DataFrame, seed: int = 11) -> tuple[GBTClassificationModel, dict[int, float]] | None:
    """Trees and a threshold for each kind, from (doc_id, found); nothing if only one class is seen.

    A bounded sample of half of the documents fits the trees. On all spans of all others the lowest chance is found at and
    above which ``PRECISION`` of a kind's spans are positives, planted ones aside, one half at least. Spans of the texts that are personal data
    written otherwise count as negatives there, as nobody labelled them; so the chance that ``RECALL`` of the planted
    ones reach will do as well, ``LEAST`` at least. A kind without either, or that no held-out document holds, gets no
    threshold and adds no span.
    """
    halves = rows.select("found", F.xxhash64("doc_id", "found", F.lit(seed)).alias("dice")).withColumn("fit", F.pmod("dice", F.lit(2)) == 0)
    sample = cut(fitting_sample(halves.where("fit")).coalesce(1))
    if sample.select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=12, maxDepth=4, stepSize=0.3, seed=seed, maxBins=16).fit(_vectors(sample))
    held = halves.where("not fit").select(F.explode("found").alias("f")).select("f.kind", "f.features", "f.planted", "f.label")
    scored = _chance(model, held).withColumn("chance", F.floor(F.col("chance") * 100) / 100)
    own, written = F.when(F.col("planted"), 0.0).otherwise(F.col("label")), F.when(F.col("planted"), F.col("label")).otherwise(0.0)
    limits: dict[int, float] = {}
    seen: dict[int, tuple[float, int, float]] = {}
    rows_of = scored.groupBy("kind", "chance").agg(F.sum(own).alias("good"), F.count_if(~F.col("planted")).alias("n"), F.sum(written).alias("written")).orderBy(F.desc("chance")).collect()
    total = {k: sum(r["written"] for r in rows_of if r["kind"] == k) for k in range(len(KINDS))}
    for row in rows_of:
        kind, chance = row["kind"], row["chance"]
        good, n, reached = seen.get(kind, (0.0, 0, 0.0))
        seen[kind] = good + row["good"], n + row["n"], reached + row["written"]
        if (row["n"] and seen[kind][0] >= PRECISION * seen[kind][1] and chance >= 0.5) or (reached < RECALL * total[kind] and chance >= LEAST):
            limits[kind] = chance
    return model, limits


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added).

    ``spans`` lists the strict spans and those the trees add, ``n_added`` counts the latter; an added span never lies
    inside or around a strict one. Null and empty texts have none. Repeated rows give repeated rows; an empty table gives
    an empty result; other columns are ignored.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = cut(proposals(rows))
    trained = train(rows)
    if trained and trained[1]:
        model, limits = trained
        # A strict span settles every span that touches it.
        strict = F.filter("found", lambda f: f["strict"])
        free = rows.select("row", F.explode(F.filter("found", lambda f: ~f["strict"] & ~f["planted"] & ~F.exists(strict, lambda b: (b["start"] < f["stop"]) & (f["start"] < b["stop"])))).alias("f"))
        limit = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))])
        added = _chance(model, free.select("row", "f.*")).where(F.col("chance") >= F.try_element_at(limit, F.col("kind")))
        added = added.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "stop")).alias("added"))
        rows = rows.join(added, "row", "left")
    else:
        rows = rows.withColumn("added", F.lit(None).cast("array<struct<start: bigint, kind: int, stop: bigint>>"))
    added = F.coalesce("added", F.array().cast("array<struct<start: bigint, kind: int, stop: bigint>>"))
    kept = F.transform(F.filter("found", lambda f: f["strict"]), lambda f: F.struct(f["start"].alias("start"), f["kind"].alias("kind"), f["stop"].alias("stop")))
    return rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", _joined(F.array_sort(F.concat(kept, added))).alias("spans"),
                       F.size(added).cast("long").alias("n_added"))
