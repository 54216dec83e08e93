"""Risk, severity and band expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch import dims
from tidewatch.functions.columns import clamp, col, lookup


def attack_severity(attack) -> Column:
    """Base severity 0..100 of an attack type, 0 if unknown."""
    return lookup(attack, dims.ATTACK_SEVERITY, 0.0)


def fused_risk(behaviour, severity, recon=None, confidence=None, weights: dict | None = None) -> Column:
    """Weighted blend of behaviour, severity, reconstruction error and confidence, clamped to 0..100."""
    w = weights or dims.RISK_WEIGHTS
    recon = F.lit(0.0) if recon is None else col(recon)
    confidence = F.lit(0.0) if confidence is None else col(confidence)
    return clamp(w["behaviour"] * col(behaviour) + w["severity"] * col(severity)
                 + w["reconstruction"] * recon + w["confidence"] * confidence, 0.0, 100.0)


def severity(confidence, anomaly, risk, risk_max: float = 100.0) -> Column:
    """Critical / High / Medium / Low from model outputs."""
    s = (col(confidence) * 0.35 + col(anomaly) * 0.35
         + F.least(col(risk) / risk_max, F.lit(1.0)) * 0.30)
    return F.when(s >= 0.80, "Critical").when(s >= 0.60, "High").when(s >= 0.35, "Medium").otherwise("Low")


def severity_rank(level) -> Column:
    """0..3; text is matched without regard to case."""
    return lookup(F.initcap(F.lower(col(level))), dims.SEVERITY_RANK)


def confidence_band(c) -> Column:
    """Display band of a confidence in percent."""
    return F.when(col(c) >= 80, "HIGH").when(col(c) >= 60, "MEDIUM").otherwise("LOW")


def risk_band(c) -> Column:
    """Display band of a risk score."""
    return (F.when(col(c) >= 75, "CRITICAL").when(col(c) >= 50, "HIGH")
            .when(col(c) >= 25, "MEDIUM").otherwise("LOW"))


def impact_label(phi) -> Column:
    """Text for the size and sign of an attribution."""
    out = None
    for edge, text in dims.IMPACT_BANDS:
        out = F.when(col(phi) >= edge, text) if out is None else out.when(col(phi) >= edge, text)
    return out.otherwise(dims.IMPACT_FLOOR)


def composite(f1, auc) -> Column:
    """Model selection score."""
    return 0.6 * col(f1) + 0.4 * col(auc)


def in_working_hours(hour, start, end) -> Column:
    """Hour within [start, end), also across midnight."""
    h, s, e = col(hour), col(start), col(end)
    return F.when(s <= e, (h >= s) & (h < e)).otherwise((h >= s) | (h < e))
