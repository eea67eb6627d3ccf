"""CVSS v3 base score of a vector string, as one column expression."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Metric weights of the public CVSS v3 specification.
ATTACK_VECTOR = {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.20}
ATTACK_COMPLEXITY = {"L": 0.77, "H": 0.44}
PRIVILEGES_UNCHANGED = {"N": 0.85, "L": 0.62, "H": 0.27}
PRIVILEGES_CHANGED = {"N": 0.85, "L": 0.68, "H": 0.50}
USER_INTERACTION = {"N": 0.85, "R": 0.62}
IMPACT = {"H": 0.56, "L": 0.22, "N": 0.0}


def _let(value: Column, body) -> Column:
    """Name an intermediate value: a one-element transform computes it once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _metric(v: Column, key: str) -> Column:
    """Last value of a metric in an upper-cased vector."""
    return F.regexp_extract(v, f"^(?:.*/)?{key}:([^/]*)", 1)


def _weight(level: Column, table: dict[str, float]) -> Column:
    out = F.when(F.lit(False), F.lit(0.0))
    for name, weight in table.items():
        out = out.when(level == name, weight)
    return out


def base_score(vector: Column | str) -> Column:
    """Score 0.0 to 10.0; NULL when a metric is missing or unknown."""
    raw = F.col(vector) if isinstance(vector, str) else vector
    keys = ("AV", "AC", "PR", "UI", "S", "C", "I", "A")

    def weights(m: Column) -> Column:
        changed = m["S"] == "C"
        return F.struct(
            changed.alias("changed"), (m["S"] != "").alias("scoped"),
            *[_weight(m[k], IMPACT).alias(k) for k in ("C", "I", "A")],
            F.when(changed, _weight(m["PR"], PRIVILEGES_CHANGED)).otherwise(_weight(m["PR"], PRIVILEGES_UNCHANGED)).alias("PR"),
            _weight(m["AV"], ATTACK_VECTOR).alias("AV"), _weight(m["AC"], ATTACK_COMPLEXITY).alias("AC"),
            _weight(m["UI"], USER_INTERACTION).alias("UI"),
        )

    def parts(w: Column) -> Column:
        sub = 1 - (1 - w["C"]) * (1 - w["I"]) * (1 - w["A"])
        impact = F.when(w["changed"], 7.52 * (sub - 0.029) - 3.25 * F.pow(sub - 0.02, F.lit(15.0))).otherwise(6.42 * sub)
        return F.struct(
            w["changed"].alias("changed"), w["scoped"].alias("scoped"), impact.alias("impact"),
            (8.22 * w["AV"] * w["AC"] * w["PR"] * w["UI"]).alias("exploit"))

    def scaled(p: Column) -> Column:
        both = p["impact"] + p["exploit"]
        total = F.least(F.when(p["changed"], 1.08 * both).otherwise(both), F.lit(10.0))
        return F.when(p["scoped"] & both.isNotNull(), F.struct(p["impact"].alias("impact"), (total * 100000).cast("long").alias("n")))

    def rounded(s: Column) -> Column:
        up = F.when(s["n"] % 10000 == 0, s["n"] / 100000.0).otherwise((F.floor(s["n"] / 10000) + 1) / 10.0)
        return F.when(s["n"].isNotNull(), F.when(s["impact"] <= 0, 0.0).otherwise(up))

    metrics = _let(F.upper(F.btrim(raw)), lambda v: F.struct(*[_metric(v, k).alias(k) for k in keys]))
    return _let(_let(_let(_let(metrics, weights), parts), scaled), rounded)


def severity(score: Column | str) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return (
        F.when(s.isNull(), "medium").when(s >= 9.0, "critical").when(s >= 7.0, "high")
        .when(s >= 4.0, "medium").when(s > 0, "low").otherwise("info")
    )
