"""Personal data: generators propose overlapping spans, boosted trees score them, calibrated thresholds select.

Four kinds: email, ip, card, phone.  Exact patterns (``BASE``) give the base spans, which always stay.  Looser generators propose more, apart
from the base spans: mail addresses with spelled-out signs, numbers in groups.  A candidate is described by its format (lengths, digits,
separators, check sum) and its context (neighbouring characters, key words before it).  Labels come from what a candidate is once its
signs and separators are restored (``meaning``), and from base spans of the corpus rewritten in their places: in a loose form (positive)
and as a look-alike (a check sum that fails, a part over 255, a spaced form without a key word; negative).  Spark's boosted trees learn from these; for each
kind the threshold is the smallest score that keeps the wanted precision on candidates that training has not seen, base spans apart.
Spans are in code points, end exclusive.  Null texts count as empty.  Time is linear in the length of a text.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators import ordering as od

from .common import long_batches, stored

KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
LOOSE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:@|\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?[A-Za-z0-9-]{1,63}){1,8}", re.I),
    "ip": re.compile(r"[0-9]{1,3}(?: ?[.·] ?[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9](?:[ ._/-]{0,2}[0-9]){11,22}"),
    "phone": re.compile(r"(?:\+ ?|\(|00)?[0-9](?:[ ()./-]{0,2}[0-9]){6,15}"),
}
SPELLED = re.compile(r"[({\[]at[)}\]]", re.I)
#: Words before a span that name its kind.
NEAR = {
    "email": re.compile(r"mail|contact|write|reach", re.I),
    "ip": re.compile(r"\bip\b|ipv4|host|server|address|connect|login", re.I),
    "card": re.compile(r"card|visa|credit|debit|amex|payment", re.I),
    "phone": re.compile(r"\btel|phone|\bcall|\bfax|mobile|\bdial|whatsapp", re.I),
}
#: The base patterns as ``base_spans`` runs them: from the "@" outward, and numbers only from the start of a run of digits.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
#: The precision the thresholds must keep, and the trees.
PRECISION = 0.98
TREES, DEPTH = 12, 4
#: An added span needs this score even where the fitted threshold is lower.
LEAST = 0.5


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _valid(kind: str, s: str) -> bool:
    if kind == "ip":
        parts = [p.lstrip("0") for p in s.split(".")]
        return all(len(p) <= 3 and int(p or "0") <= 255 for p in parts)
    if kind == "card":
        d = _digits(s)
        return 16 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 8 <= len(_digits(s)) <= 15


def _emails(text: str) -> list[tuple[int, int]]:
    """The leftmost matches of the email pattern; no character before an "@" is looked at twice."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        head = text[floor:at]
        start = floor + len(head.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
        floor = m.end() if m else at + 1
        at = text.find("@", floor)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost matches that don't overlap, of each kind; those that fail their check are dropped."""
    return {"email": _emails(text), "ip": [m.span() for m in _IP.finditer(text) if _valid("ip", m.group())],
            "card": [m.span() for m in BASE["card"].finditer(text) if _valid("card", m.group())],
            "phone": [m.span() for m in BASE["phone"].finditer(text) if _valid("phone", m.group())] if "+" in text else []}


def _restored(kind: str, s: str) -> str:
    """A loose form in its plain writing."""
    if kind == "email":
        s = re.sub(r"[({\[]dot[)}\]]", ".", SPELLED.sub("@", s), flags=re.I)
        return re.sub(" ", "", s)
    return ".".join(re.findall("[0-9]+", s)) if kind == "ip" else _digits(s)


def meaning(kind: str, text: str, a: int, b: int) -> bool:
    """Whether a candidate is personal data once its signs and separators are restored, judged with the words around it.

    email: an address ending in letters, with spelled signs or after a word such as "mail".  ip: four parts up to 255 after a word such
    as "server".  card: 16 to 19 digits, or 13 to 15 after a word such as "card", with a right check sum.  phone: 8 to 15 digits (7 with
    brackets) after a word such as "call", or in international writing.  Numbers that go on before or after the span are none.
    """
    s, plain, named = text[a:b], _restored(kind, text[a:b]), bool(NEAR[kind].search(text[max(0, a - 24):a]))
    if kind == "email":
        return bool(BASE["email"].fullmatch(plain)) and plain.rsplit(".", 1)[-1].isalpha() and len(plain.rsplit(".", 1)[-1]) > 1 and (bool(SPELLED.search(s)) or named)
    if re.search(r"[\w.]$", text[max(0, a - 1):a]) or re.match(r"\w|[.-]\d", text[b:b + 2]):
        return False
    if kind == "ip":
        return named and all(len(p) <= 3 and int(p) <= 255 for p in plain.split("."))
    if kind == "card":
        return luhn(plain) and len(set(plain)) > 1 and (16 <= len(plain) <= 19 or named and 13 <= len(plain) <= 15)
    return (8 if "(" not in s else 7) <= len(plain) <= 15 and not re.fullmatch(r"[0-9]{4}[-/.][0-9]{2}[-/.][0-9]{2}", s) and (named or s[0] == "+" and plain[0] != "0")


def _features(kind: int, text: str, a: int, b: int) -> list[float]:
    s, before, after = text[a:b], text[max(0, a - 24):a], text[b:b + 8]
    d = _digits(s)
    signs = [c for c in s if not c.isalnum()]
    groups = [len(g) for g in re.findall(r"[0-9]+", s)]
    prev, follow = before[-1:], after[:1]
    end = _restored("email", s).rsplit(".", 1)[-1] if kind == 0 else ""
    return [float(kind), float(b - a), float(len(d)), len(d) / (b - a), float(len(signs)), float(len(set(signs))), float(len(groups)),
            float(max(groups, default=0)), float(min(groups, default=0)), float(luhn(d)) if d else 0.0, float(s[0] == "+"), float("@" in s), float(bool(SPELLED.search(s))),
            float(s.count(".")), float(s.count(" ")), float(s.count("-")), float("(" in s), float(max((int(g[:6]) for g in re.findall(r"[0-9]+", s)), default=0)),
            float(len(end)), float(end.isalpha()), float(len(set(d))), float(prev.isspace() or not prev), float(prev.isalnum()), float(prev != "" and prev in "+.-_="),
            float(follow.isspace() or not follow), float(follow.isalnum()), float(follow != "" and follow in ".,;:!?)"), float(after[:1] in (".", "-") and after[1:2].isdigit()),
            float(bool(re.fullmatch(r"[0-9]{4}[-/.][0-9]{2}[-/.][0-9]{2}", s))), *(float(bool(NEAR[k].search(before))) for k in KINDS), float("=" in before[-4:] or ":" in before[-4:])]


def _rewritten(kind: str, s: str, turn: int) -> tuple[str, str, str]:
    """A base span in a loose form, a look-alike, and a key word for the place before the loose form."""
    if kind == "email":
        at, dot = (("(at)", "(dot)"), (" [at] ", " [dot] "), (" {at} ", "."), (" (at) ", " (dot) "))[turn % 4]
        user, host = s.split("@", 1)
        name, *_, top = host.split(".")
        return f"{user}{at}{host.replace('.', dot)}", f"{user[:20]} @ {name} .{'5' if turn // 4 % 2 else ' ' + top}", "mail "
    if kind == "ip":
        parts = [p.lstrip("0")[:3] or "0" for p in s.split(".")]
        sep = (" . ", ". ", "·", " .")[turn % 4]
        return sep.join(parts), sep.join([str(256 + turn % 700) if turn // 4 % 2 else parts[0], *parts[1:]]), "server "
    d = _digits(s)
    if kind == "card":
        sep = (".", "/", "_", "  ")[turn % 4]
        wrong = d[:-1] + str((int(d[-1]) + 1 + turn % 9) % 10)
        return sep.join(d[i:i + 4] for i in range(0, len(d), 4)), sep.join(wrong[i:i + 4] for i in range(0, len(d), 4)), "card "
    loose = (f"({d[:3]}) {d[3:6]}-{d[6:]}", f"00{d[:2]} {d[2:]}"[:18], f"{d[:3]} {d[3:6]} {d[6:]}", f"{d[:4]}/{d[4:]}")[turn % 4]
    return loose, f"{d[:3]} {d[3:6]} {d[6:]}", "call "


def candidates(text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[int, int, int, int, bool, list[float]]]:
    """What the loose generators find apart from base spans (spans of several kinds may overlap), and what training gets besides: kind, start, end,
    use (0 proposed, 1 base span, 2 rewritten base span), label, features."""
    out = []
    inside = sorted(x for spans in base.values() for x in spans)
    for k, kind in enumerate(KINDS):
        if kind != "email" or "@" in text or SPELLED.search(text):
            near, i = 0, 0   # the furthest end of the base spans that begin before the match ends
            for m in LOOSE[kind].finditer(text):
                a, b = m.span()
                while i < len(inside) and inside[i][0] < b:
                    near, i = max(near, inside[i][1]), i + 1
                if near <= a:
                    out.append((k, a, b, 0, meaning(kind, text, a, b), _features(k, text, a, b)))
        for a, b in base[kind]:
            out.append((k, a, b, 1, True, _features(k, text, a, b)))
            loose, alike, word = _rewritten(kind, text[a:b][-100:], zlib.crc32(f"{a}:{text[a:b]}".encode()))
            before, after = text[max(0, a - 24):a], text[b:b + 8]
            for lead, form, label in ((before + word, loose, True), (NEAR[kind].sub("", before), alike, False)):
                out.append((k, a, b, 2, label, _features(k, lead + form + after, len(lead), len(lead) + len(form))))
    return out


SCAN = T.StructType([T.StructField("row", T.LongType()), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS),
                     T.StructField("base", T.ArrayType(T.LongType())), T.StructField("maybe", T.ArrayType(T.StructType([
                         T.StructField("kind", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                         T.StructField("use", T.IntegerType()), T.StructField("label", T.BooleanType()), T.StructField("features", T.ArrayType(T.DoubleType()))])))])
_MAYBE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("use", pa.int32()), ("label", pa.bool_()), ("features", pa.list_(pa.float64()))]))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: its key, counts, base spans (flat: kind, start, end) and candidates with features."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in long_batches(whole, "text"):
                counts, flat, maybe = [], [], []
                for t in b.column(1).to_pylist():
                    base = base_spans(t or "")
                    counts.append([len(base[k]) for k in KINDS])
                    flat.append([x for k, kind in enumerate(KINDS) for a, e in base[kind] for x in (k, a, e)])
                    maybe.append([dict(zip(("kind", "start", "end", "use", "label", "features"), c)) for c in candidates(t or "", base)])
                n = np.array(counts, dtype=np.int64).reshape(-1, len(KINDS))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(n[:, i]) for i in range(len(KINDS))), pa.array(flat, pa.list_(pa.int64())), pa.array(maybe, _MAYBE)],
                                                 ["row", *(f"n_{k}" for k in KINDS), "base", "maybe"])

    return docs.select(F.col(key).cast("long").alias("row"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCAN)


def fit(scanned: DataFrame):
    """Trees and thresholds, or None when the candidates to train on have only one class.

    All candidates take part: half of them (by hash) train, the other half calibrates.  The driver gets one threshold a kind.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    one = scanned.select("row", F.explode("maybe").alias("m")).select("row", "m.*")
    h = F.xxhash64("row", "kind", "start", "end", "use", "label")
    every = stored(one.select("kind", "use", F.col("label").cast("double").alias("label"), h.alias("h"), "features"), "candidates").withColumn("features", array_to_vector("features"))
    train, rest = every.filter((F.col("h") % 2) == 0), every.filter((F.col("h") % 2) != 0)
    if train.agg(F.count_distinct("label").alias("n")).first()["n"] < 2:
        return None
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=64, seed=7).fit(train)
    # kept candidates and good ones by threshold: running sums over the distinct scores of a kind
    scores = model.transform(rest.filter("use <> 1")).groupBy("kind", vector_to_array("probability")[1].alias("p")).agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("good"))
    scores, o = od.order_by(stored(scores, "scores"), ["kind"], -F.col("p"), ["p"])
    sums = od.done(od.running_sum(scores, o, {"_n": "n", "_good": "good"}))
    least = {r["kind"]: r["p"] for r in sums.filter(F.col("_good") / F.col("_n") >= PRECISION).groupBy("kind").agg(F.min("p").alias("p")).collect()}
    return model, {k: max(least.get(k, 1.1), LEAST) for k in range(len(KINDS))}


def _text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sha, every = [], []
        for flat, more in zip(b.column("base").to_pylist(), b.column("more").to_pylist()):
            base = list(zip(flat[::3], flat[1::3], flat[2::3]))
            taken, spans = [], list(base)   # disjoint spans in order
            for a, e in sorted((a, e) for _, a, e in base):
                if taken and a <= taken[-1][1]:
                    taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
                else:
                    taken.append((a, e))
            for x in sorted(more or [], key=lambda x: (-x["p"], x["start"], -x["end"], x["kind"])):
                i = bisect_left(taken, (x["start"], x["start"]))
                if (i == len(taken) or x["end"] <= taken[i][0]) and (i == 0 or taken[i - 1][1] <= x["start"]):
                    taken.insert(i, (x["start"], x["end"]))
                    spans.append((x["kind"], x["start"], x["end"]))
            sha.append(hashlib.sha256(_text(base).encode()).hexdigest())
            every.append(_text(spans))
        yield pa.RecordBatch.from_arrays([b.column("row"), *(b.column(f"n_{k}") for k in KINDS), pa.array(sha), pa.array(every)],
                                         ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts of base spans, their digest, and all spans (base and added) of every document.

    One pass over the texts.  Candidates are scored apart from them, and the added ones join their document's row by its number.
    """
    scanned = stored(scan(docs, key, text).withColumn("at", F.monotonically_increasing_id()), "scan")
    found = fit(scanned)
    if found is None:
        picked = scanned.withColumn("more", F.array().cast("array<struct<kind:int,start:long,end:long,p:double>>"))
    else:
        from pyspark.ml.functions import array_to_vector, vector_to_array

        model, limits = found
        one = scanned.select("at", F.explode("maybe").alias("m")).select("at", "m.*").filter("use = 0").withColumn("features", array_to_vector("features"))
        limit = F.create_map(*(F.lit(x) for kv in limits.items() for x in kv))
        scored = model.transform(one).withColumn("p", vector_to_array("probability")[1]).filter(F.col("p") >= limit[F.col("kind")])
        added = scored.groupBy("at").agg(F.collect_list(F.struct("kind", "start", "end", "p")).alias("more"))
        picked = scanned.join(added, "at", "left")
    return picked.select("row", *(f"n_{k}" for k in KINDS), "base", "more").mapInArrow(
        _finish, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def redact(text: str, spans: str) -> str:
    """The text with every span replaced by its kind in brackets."""
    found = sorted(((int(a), int(b), k) for k, a, b in (x.split(":") for x in spans.split(",") if x)), reverse=True)
    for a, b, k in found:
        text = f"{text[:a]}[{k}]{text[b:]}"
    return text
