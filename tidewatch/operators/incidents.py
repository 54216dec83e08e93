"""Incident records, triage queries, recommendations and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import dims, texts
from tidewatch.functions.columns import nonblank
from tidewatch.operators.explain import percent
from tidewatch.operators.risk import BASELINE_TEXT

TIERS = ["immediate_containment", "investigation", "remediation", "recovery"]
ISOLATE = texts.ACTION["isolate"]


def top3(df: DataFrame) -> Column:
    """Array of (attack, probability) from the wide prediction columns, blanks dropped."""
    pairs = F.array(*[F.struct(nonblank(f"top_{i}").alias("attack"),
                               F.round(F.coalesce(F.col(f"top_{i}_prob").cast("double"), F.lit(0.0)), 4).alias("probability"))
                      for i in (1, 2, 3)])
    return F.filter(pairs, lambda p: p["attack"].isNotNull())


def build_incidents(expl: DataFrame, pred: DataFrame, features: DataFrame) -> DataFrame:
    """Explanations worth a look (not Normal or positive risk) with predictions and
    feature metadata; a non-zero risk of the data set wins over the explanation's."""
    e = expl.where((F.col("prediction") != "Normal") | (F.col("risk_score") > 0))
    p = pred.select("session_id", top3(pred).alias("top3"))
    f = features.select("session_id", "employee_id", F.col("risk_score").alias("_ds_risk"),
                        F.col("session_start_hour").cast("int").alias("session_start_hour"),
                        (F.col("session_duration") / 60).alias("session_duration_minutes"))
    out = e.join(p, "session_id", "left").join(f, "session_id", "left")
    return (out.withColumnRenamed("prediction", "attack_type")
            .withColumn("employee_id", F.coalesce("employee_id", F.lit("Unknown")))
            .withColumn("confidence", F.coalesce("confidence", F.lit(0.5)))
            .withColumn("top3", F.coalesce("top3", F.array().cast("array<struct<attack:string,probability:double>>")))
            .withColumn("risk_score", F.coalesce(F.nullif("_ds_risk", F.lit(0.0)), "risk_score", F.lit(0.0)))
            .drop("_ds_risk"))


def lookup(incidents: DataFrame, ids: DataFrame) -> DataFrame:
    """Incidents of the requested ids; an unknown id yields the default record."""
    out = ids.select("session_id").join(incidents, "session_id", "left")
    known = F.col("attack_type").isNotNull()
    default = {"employee_id": "Unknown", "attack_type": "Normal", "confidence": 1.0, "severity": "Low",
               "risk_score": 0.0, "anomaly_score": 0.0, "summary": BASELINE_TEXT, "nl_explanation": BASELINE_TEXT}
    new = {c: F.when(known, F.col(c)).otherwise(F.lit(v)) for c, v in default.items() if c in out.columns}
    return out.withColumns(new)


def anomalous(df: DataFrame) -> DataFrame:
    """Incidents classified as an attack."""
    return df.where(F.col("attack_type") != "Normal")


def by_severity(df: DataFrame, level: str) -> DataFrame:
    """Incidents of one severity, case ignored."""
    return df.where(F.lower("severity") == level.lower())


def high_critical(df: DataFrame) -> DataFrame:
    """High and Critical incidents."""
    return df.where(F.col("severity").isin("High", "Critical"))


def merge_live(live: DataFrame, stored: DataFrame, key: str = "session_id", order: str = "incident_no") -> DataFrame:
    """Live and stored incidents, one per session, the live one first.

    Of several live rows of one session the first by ``order`` stays (NULL first); without
    that column live rows must be unique.  A keyed minimum over the source number
    combines map-side, so many copies of one session do not meet in one task.
    """
    both = (live.withColumn("_src", F.lit(0)).unionByName(stored.withColumn("_src", F.lit(1)), allowMissingColumns=True))
    rest = [c for c in both.columns if c not in (key, "_src")]
    return (both.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("_src", *[c for c in rest if c == order])).alias("_r"))
            .select(key, "_r.*"))


def default_playbooks(spark) -> DataFrame:
    """Playbooks for sites without their own: containment and recovery by kind of case, all investigation steps, remediation by the last of them."""
    rows = [(a, list(texts.PLAYBOOK_KIND[a][0]), list(s), [s[-1]], list(texts.PLAYBOOK_KIND[a][1])) for a, s in texts.INVESTIGATION_STEPS.items()]
    return spark.createDataFrame(rows, "attack_type string, " + ", ".join(f"{t} array<string>" for t in TIERS))


def read_playbooks(spark, path: str) -> DataFrame:
    """Playbooks from a JSON file ``{attack: {tier: [steps]}}``."""
    tier = ", ".join(f"{t}: array<string>" for t in TIERS)
    text = spark.read.text(path, wholetext=True)  # one small configuration file
    m = text.select(F.explode(F.from_json("value", f"map<string, struct<{tier}>>")).alias("attack_type", "p"))
    return m.select("attack_type", "p.*")


def priority_action(steps: str = "immediate_containment") -> Column:
    """Most urgent action from the three strongest positive features, else the first step."""
    top = F.transform(F.slice("positive_contributors", 1, 3), lambda c: c["feature"])

    def has(*names: str) -> Column:
        return F.arrays_overlap(top, F.array(*[F.lit(n) for n in names]))
    return (F.when(F.col("attack_type") == "Normal", texts.ACTION["none"])
            .when(has("powershell_executions", "powershell_position"),
                  texts.ACTION["script"])
            .when(has("total_upload_bytes", "files_downloaded"),
                  texts.ACTION["outgoing"])
            .when(has("failed_login_count"), texts.ACTION["sign_in"])
            .when(has("admin_resource_accesses", "admin_access_position"),
                  texts.ACTION["admin"])
            .otherwise(F.coalesce(F.get(steps, 0), F.lit(texts.ACTION["look"]))))


def recommend(incidents: DataFrame, playbooks: DataFrame, impact: dict[str, str] | None = None) -> DataFrame:
    """Four-tier playbook, adjusted for severity, with priority action and impact.

    The playbook table has one row per attack class.
    """
    impact = impact or texts.BUSINESS_IMPACT
    base = playbooks.where(F.col("attack_type") == "Normal").select(*[F.col(t).alias(f"_n_{t}") for t in TIERS])
    out = (incidents.join(playbooks.select("attack_type", *TIERS), "attack_type", "left")
           .crossJoin(F.broadcast(base)))
    out = out.withColumns({t: F.coalesce(t, f"_n_{t}") for t in TIERS}).drop(*[f"_n_{t}" for t in TIERS])
    imm, inv = F.col("immediate_containment"), F.col("investigation")
    lead = F.when(F.array_contains(imm, ISOLATE) | (F.col("attack_type") == "Normal"), imm).otherwise(F.array_prepend(imm, F.lit(ISOLATE)))
    crit, high = F.col("severity") == "Critical", F.col("severity") == "High"
    out = out.withColumns({
        "immediate_containment": F.when(crit, F.array_append(lead, F.lit(texts.ACTION["page"])))
        .when(high, F.array_append(imm, F.lit(texts.ACTION["inform"]))).otherwise(imm),
        "investigation": F.when(crit, F.array_append(inv, F.lit(texts.ACTION["hunt"])))
        .when(high, F.array_append(inv, F.lit(texts.ACTION["audit"]))).otherwise(inv),
    })
    table = F.create_map(*[F.lit(v) for kv in impact.items() for v in kv])
    return (out.withColumn("priority_action", priority_action())
            .withColumn("estimated_impact", F.coalesce(table[F.col("attack_type")], F.lit(texts.NO_IMPACT))))


# --- texts -----------------------------------------------------------------

def _first_step() -> Column:
    return F.coalesce(F.get("investigation_steps", 0), F.lit("Investigate the session activity."))


def _features(n: int) -> Column:
    return F.transform(F.slice("positive_contributors", 1, n), lambda c: c["feature"])


def summaries(inc: DataFrame) -> DataFrame:
    """Dashboard, executive, analyst and e-mail texts from templates."""
    normal = F.col("attack_type") == "Normal"
    sid, emp, atk, sev = (F.col(c) for c in ("session_id", "employee_id", "attack_type", "severity"))
    feats = F.when(F.size(_features(2)) > 0, F.array_join(_features(2), " and ")).otherwise("behavioral markers")
    tactic = F.when(F.col("mitre").isNotNull(), F.concat(F.lit("MITRE: "), F.col("mitre.tactic"), F.lit(" | "), F.col("mitre.technique_id"),
                                                         F.lit(" "), F.col("mitre.technique"))).otherwise("No MITRE mapping")
    evidence = F.array_join(F.transform(F.slice("positive_contributors", 1, 5), lambda c: F.concat(
        F.lit("  - "), c["feature"], F.lit(" = "), c["value"].cast("string"), F.lit(" ("), c["impact"], F.lit(")"))), "\n")
    two, four = (lambda c: F.format_string("%.2f", F.col(c))), (lambda c: F.format_string("%.4f", F.col(c)))
    dashboard = F.when(normal, F.concat(F.lit("Session "), sid, F.lit(" shows baseline behaviour."))).otherwise(F.concat(
        F.lit("Anomalous session of employee "), emp, F.lit(" classified as "), atk, F.lit(" ("), sev, F.lit(" severity, "),
        percent("confidence"), F.lit(" confidence). Key indicators: "), feats, F.lit(". Action: "), _first_step()))
    executive = F.when(normal, F.lit("No anomalous behavior detected.")).otherwise(F.concat(
        F.lit("A security anomaly was detected in session "), sid, F.lit(" (employee "), emp, F.lit("). It resembles a "), atk,
        F.lit(" attempt of "), sev, F.lit(" severity at "), percent("confidence", 1), F.lit(" confidence, anomaly score "),
        four("anomaly_score"), F.lit(". Recommended: "), _first_step()))
    soc = F.when(normal, F.lit("Triage: normal activity.")).otherwise(F.concat_ws(
        "\n", F.lit("[TRIAGE SUMMARY]"), F.concat(F.lit("Incident: "), sid), F.concat(F.lit("Employee: "), emp),
        F.concat(F.lit("Prediction: "), atk, F.lit(" ("), percent("confidence", 1), F.lit(")")),
        F.concat(F.lit("Risk: "), two("risk_score"), F.lit(" anomaly "), four("anomaly_score")),
        F.concat(F.lit("Severity: "), sev), tactic, F.lit("Evidence:"), evidence, F.concat(F.lit("Next: "), _first_step())))
    tag = F.coalesce(F.concat(F.lit(" ["), F.col("mitre.technique_id"), F.lit("]")), F.lit(""))
    mail = F.when(normal, F.concat(F.lit("Subject: [INFO] Baseline activity - session "), sid)).otherwise(F.concat_ws(
        "\n", F.concat(F.lit("Subject: [ALERT - "), F.upper(sev), F.lit("] "), atk, tag, F.lit(" (session "), sid, F.lit(")")),
        F.lit(""), F.concat(F.lit("- Incident: "), sid, F.lit(" (employee "), emp, F.lit(")")),
        F.concat(F.lit("- Class: "), atk, F.lit(" "), percent("confidence"), F.lit(" | "), sev),
        F.concat(F.lit("- Risk: "), two("risk_score"), F.lit(" | anomaly "), four("anomaly_score")),
        F.concat(F.lit("- Indicators: "), F.array_join(_features(3), ", ")), F.concat(F.lit("- Action: "), _first_step())))
    return inc.select("session_id", "employee_id", "attack_type", "severity", "confidence", dashboard.alias("dashboard"),
                      executive.alias("executive"), soc.alias("soc"), mail.alias("email"))


def cards(recs: DataFrame, sums: DataFrame) -> DataFrame:
    """Dashboard cards."""
    s = sums.select("session_id", F.col("dashboard").alias("summary"))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return recs.join(s, "session_id").select(
        "session_id", F.col("employee_id").alias("employee"), "attack_type", "severity",
        F.round("confidence", 4).alias("confidence"), F.round("risk_score", 2).alias("risk_score"), "summary",
        F.col("priority_action").alias("recommended_action"), blank("mitre.tactic").alias("mitre_tactic"),
        blank("mitre.technique").alias("mitre_technique"), _features(5).alias("top_features"))


SECTIONS = [  # FIXED VALUES: titles become the keys of the section map
    "Executive Summary", "Incident Overview", "Attack Classification & Prediction", "Severity Assessment",
    "MITRE ATT&CK Mapping", "Behavioral Indicators", "Key SHAP Evidence", "Exonerating/Counteracting Factors",
    "Risk Assessment", "Potential Business Impact", "Containment Actions", "Investigation Checklist",
    "Remediation Plan", "Recovery Recommendations", "Lessons Learned",
]


def report(recs: DataFrame) -> DataFrame:
    """Report text with fifteen numbered sections, one row per incident."""
    def lines(c: str, n: int, empty: str) -> Column:
        t = F.transform(F.slice(c, 1, n), lambda x: F.concat(F.lit("- **"), x["feature"], F.lit("**: "), x["value"].cast("string"),
                                                             F.lit(", "), F.lower(x["impact"])))
        return F.when(F.size(t) > 0, F.array_join(t, "\n")).otherwise(empty)

    def todo(c: str) -> Column:
        return F.array_join(F.transform(c, lambda s: F.concat(F.lit("- [ ] "), s)), "\n")
    atk, sev = F.col("attack_type"), F.col("severity")
    risk = F.format_string("%.2f", F.col("risk_score"))
    anom = F.format_string("%.4f", F.col("anomaly_score"))
    na = lambda c, d="N/A": F.coalesce(F.col(c).cast("string"), F.lit(d))
    best = F.array_join(F.transform("top3", lambda p: F.concat(p["attack"], F.lit(" ("), percent(p["probability"]), F.lit(")"))), ", ")
    body = [
        F.concat(F.lit("Session **"), F.col("session_id"), F.lit("** of employee **"), F.col("employee_id"), F.lit("** was classified as **"),
                 atk, F.lit("** at "), percent("confidence", 1), F.lit(" confidence, severity **"), sev, F.lit("**.")),
        F.concat_ws("\n", F.concat(F.lit("- Session: "), F.col("session_id")), F.concat(F.lit("- Employee: "), F.col("employee_id")),
                    F.concat(F.lit("- Hour: "), na("session_start_hour", "Unknown")),
                    F.concat(F.lit("- Minutes: "), F.coalesce(F.format_string("%.1f", F.col("session_duration_minutes")), F.lit("Unknown")))),
        F.concat_ws("\n", F.concat(F.lit("- Prediction: "), atk), F.concat(F.lit("- Confidence: "), percent("confidence", 1)),
                    F.concat(F.lit("- Candidates: "), F.when(best != "", best).otherwise("N/A"))),
        F.concat(F.lit("Severity **"), sev, F.lit("** from risk "), risk, F.lit(" and anomaly score "), anom, F.lit(".")),
        F.concat_ws("\n", F.concat(F.lit("- Tactic: "), na("mitre.tactic")), F.concat(F.lit("- Technique: "), na("mitre.technique_id"), F.lit(" "), na("mitre.technique"))),
        F.concat_ws("\n", F.concat(F.lit("- Risk score: "), risk), F.concat(F.lit("- Anomaly score: "), anom)),
        lines("positive_contributors", 6, "- none"), lines("negative_contributors", 4, "- none"),
        F.concat(F.lit("Risk score **"), risk, F.lit("**, anomaly score **"), anom, F.lit("**.")),
        F.col("estimated_impact"), todo("immediate_containment"), todo("investigation"), todo("remediation"), todo("recovery"),
        F.lit("- Review access policies with the user.\n- Audit permissions regularly.\n- Add monitoring for the indicators above."),
    ]
    parts = [F.concat(F.lit(f"## {i + 1}. {t}\n"), F.coalesce(b, F.lit(""))) for i, (t, b) in enumerate(zip(SECTIONS, body))]
    return recs.withColumn("report_text", F.concat_ws("\n\n", F.concat(F.lit("# Incident report: "), F.col("session_id")), *parts))


def split_sections(df: DataFrame, text: str = "report_text") -> DataFrame:
    """``sections``: map of section key to body; the whole text under ``full_text``
    when there is no heading."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), F.col(text)), "\n## +"), lambda p, i: i > 0)
    title = lambda p: F.trim(F.regexp_replace(F.substring_index(p, "\n", 1), "^\\d+\\.\\s*", ""))
    key = lambda p: F.replace(F.replace(F.lower(title(p)), F.lit(" "), F.lit("_")), F.lit("&"), F.lit("and"))
    body = lambda p: F.trim(F.regexp_replace(p, "^[^\n]*\n?", ""))
    clean = lambda b: F.regexp_replace(F.regexp_replace(b, "^\\s+", ""), "\\s+$", "")
    m = F.map_from_entries(F.transform(parts, lambda p: F.struct(key(p), clean(body(p)))))
    whole = F.create_map(F.lit("full_text"), F.col(text))
    return df.withColumn("sections", F.when(F.size(parts) > 0, m).otherwise(whole))


def serialise(inc: DataFrame) -> Column:
    """The facts of an incident as one JSON text."""
    cols = [c for c in ("session_id", "employee_id", "attack_type", "confidence", "top3", "severity", "risk_score",
                        "anomaly_score", "source_ip", "device_id", "session_start_hour", "session_duration_minutes", "mitre",
                        "investigation_steps", "nl_explanation") if c in inc.columns]
    parts = [F.col(c) for c in cols]
    if "positive_contributors" in inc.columns:
        parts += [F.slice("positive_contributors", 1, 8).alias("positive_contributors"),
                  F.slice("negative_contributors", 1, 5).alias("negative_contributors")]
    return F.to_json(F.struct(*parts))


def severity_label(rank: Column) -> Column:
    """Text of a severity rank."""
    return F.array(*[F.lit(s) for s in dims.SEVERITY_RANK])[rank.cast("int")]
