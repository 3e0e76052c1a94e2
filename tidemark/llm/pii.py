"""Operator 8: personal data by weak supervision, in DataFrame functions only.

Regular expressions propose spans. Five labelers (strict pattern, gazetteer, words before, words after, plausible shape) vote
for or against each, or abstain; they may disagree. The votes of all documents are counted by pattern - at most 9 kinds x 3^5
patterns, so the counts fit any driver - and expectation-maximisation over the counts estimates how reliable each labeler is.
A logistic span classifier is trained on the resulting soft labels and becomes a column expression. Spans of the four base
kinds are always kept; the classifier adds those of the other kinds that it accepts and that touch no base span.

Positions are code points. They come from the lengths of what lies between the matches, as SQL has no match positions. Arrays
are built in runs of ``RUN`` entries and runs of runs and texts are cut in blocks of ``CUT`` code points, so that the time for a text grows with
its length and its number of matches, not with their product.

Cases: null and empty texts have no spans; repeated rows give repeated results; without any candidate the classifier
adds nothing; other columns are ignored (``redact`` keeps them, whatever their names).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import aside, saved, table

# Possessive forms of the contract's patterns. Nothing after a repetition can take back what it has read, so the matches
# are the same, and Java neither recurses nor reads a long run once for each of its characters.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
EXTRA = {
    "local_phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])",
    "social": r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "hidden_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z]{2,20})++",
    "secret": r"(?<![A-Za-z0-9])(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Pp]assw(?:or)?d|PASSWORD|[Aa]pi[_-]?[Kk]ey|API_KEY|[Aa]ccess[_-]?[Kk]ey)\x20{0,2}[:=]\x20{0,2}[\"']?[A-Za-z0-9+/=_.-]{8,}+[\"']?",
    "titled_name": r"(?<![\p{L}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Sr|Sra)\.?\x20\p{Lu}\p{Ll}{1,30}(?:\x20\p{Lu}\p{Ll}{1,30})?",
}
KINDS = [*BASE, *EXTRA]
ANY_EXTRA = "|".join(f"(?:{p})" for p in EXTRA.values())
OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Labelers' word lists.
DOMAINS = r"(?i)(?:mail|gmail|yahoo|hotmail|outlook|proton|icloud|\.(?:com|org|net|edu|gov|info|de|fr|es|uk|it|nl|at|ch|mx|ar)\b)"
GIVEN = r"\b(?:Anna|Ana|Maria|Marie|Jean|John|James|Mary|Peter|Pierre|Pedro|Paul|Pablo|Hans|Klaus|Jürgen|Sophie|Sofia|Luis|Louis|Carlos|Charles|Michael|Miguel|Michel|David|Daniel|Thomas|Robert|William|Elizabeth|Isabel|Laura|Julia|Juan|José|Jose|Martin|Andrea|Stefan|Claire|Emma|Lucas|Felix|Karl|Otto|Helga|Ursula)\b"
ISSUED = r"^(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20}|\bsk-[A-Za-z0-9]{16}|xox[abp]-|eyJ[A-Za-z0-9_-]{10}|[0-9a-f]{32}"
CONTEXT = r"(?i)(?:e-?mail|contact|write|tel|phone|call|fax|mobile|card|visa|account|ssn|social|address|host|server|login|user|export|header|bearer|correo|courriel|anruf|telefon|tarjeta|carte|karte|signed|regards|dear|sincerely)"
AGAINST = r"(?i)(?:version|isbn|issn|order|invoice|part|figure|table|chapter|section|page|example|\$|€|#)\W*$"
UNITS = r"(?i)^\W{0,2}(?:%|€|\$|usd|eur|kg|km|cm|mm|ml|units?|pages?|pieces|items|times|years?|street|avenue|award|prize|method|effect)"
LABELERS = ("pattern", "gazetteer", "before", "after", "shape")
#: Code points around a match that labelers see, as far as the next match of the same pattern.
AROUND = 24
#: Entries that are gathered one by one before they are joined to those gathered so far (and so many such runs before the
#: next join), and code points of a block of text.
RUN, CUT = 48, 1024
SPAN = "array<struct<kind:string,start:int,end:int,match:string,before:string,after:string>>"
BASE_SPANS, EXTRA_SPANS, ALL_SPANS = "__pii_base", "__pii_extra", "__pii_spans"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """What ``step(carry, item)`` gives for each item next to the carry for the following one, as an array of type ``kind``."""
    none, none_yet = F.expr(f"cast(array() as {kind})"), F.expr(f"cast(array() as array<{kind}>)")

    def one(acc: Column, x: Column) -> Column:
        carry, out = step(acc["carry"], x)
        return F.struct(carry.alias("carry"), F.concat(acc["out"], F.array(out)).alias("out"))

    def walk(part: Column, carry: Column, size: int, done: Callable[[Column], Column]) -> Column:
        """``done`` of the struct of the last carry and the outputs for ``part``, walked in runs of ``size``."""
        if size == 1:
            return F.aggregate(part, F.struct(carry.alias("carry"), none.alias("out")), one, done)

        def some(acc: Column, first: Column) -> Column:
            more = lambda r: F.struct(r["carry"].alias("carry"), F.concat(acc["out"], F.array(r["out"])).alias("out"))
            return let(F.slice(part, first, F.lit(size)), lambda p: walk(p, acc["carry"], size // RUN, more))

        begin = F.struct(carry.alias("carry"), none_yet.alias("out"))
        return F.aggregate(F.sequence(F.lit(1), F.size(part), F.lit(size)), begin, some, lambda r: done(F.struct(r["carry"].alias("carry"), F.flatten(r["out"]).alias("out"))))

    return F.when(F.size(items) > 0, walk(items, start, RUN * RUN, lambda r: r["out"])).otherwise(none)


def _spans(text: Column, pattern: str, kind: str, valid: Callable[[Column], Column] | None = None) -> Column:
    """Valid matches of ``pattern`` with what is around them, as SPAN."""

    def placed(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["gap"])
        end = start + F.length(x["match"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["match"].alias("match"), F.right(x["gap"], F.lit(AROUND)).alias("before"), F.left(x["next"], F.lit(AROUND)).alias("after"))
        return end, span

    def walk(found: Column, parts: Column) -> Column:
        between = F.zip_with(F.slice(parts, F.lit(1), F.size(found)), F.slice(parts, F.lit(2), F.size(found)), lambda g, h: F.struct(g.alias("gap"), h.alias("next")))
        items = F.zip_with(between, found, lambda b, m: F.struct(b["gap"].alias("gap"), b["next"].alias("next"), m.alias("match")))
        got = let(items, lambda i: running(i, F.lit(0), placed, SPAN))
        return F.filter(got, lambda s: valid(s["match"])) if valid else got

    none = F.expr(f"cast(array() as {SPAN})")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda f: F.when(F.size(f) > 0, let(F.split(text, pattern, -1), lambda p: walk(f, p))).otherwise(none))


def base_spans(text: Column) -> dict[str, Column]:
    none = F.expr(f"cast(array() as {SPAN})")
    digits = lambda m: F.regexp_replace(m, "[^0-9]", "")
    return {
        "email": F.when(F.contains(text, F.lit("@")), _spans(text, BASE["email"], "email")).otherwise(none),
        "ip": _spans(text, BASE["ip"], "ip", lambda m: m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")),
        "card": _spans(text, BASE["card"], "card", lambda m: F.length(digits(m)).between(16, 19) & F.call_function("luhn_check", digits(m))),
        "phone": F.when(F.contains(text, F.lit("+")), _spans(text, BASE["phone"], "phone", lambda m: F.length(digits(m)).between(8, 15))).otherwise(none),
    }


def apart(extra: Column, base: Column) -> Column:
    """The spans of ``extra`` that touch none of ``base``, both SPAN, in order: one scan from either end."""
    flag = lambda spans, own: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(own).alias("own"), F.lit(True).alias("free"), s.alias("s")))
    kind = f"array<struct<start:int,end:int,own:boolean,free:boolean,s:{SPAN[6:-1]}>>"

    def marked(x: Column, free: Column) -> Column:
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["own"].alias("own"), free.alias("free"), x["s"].alias("s"))

    def rightwards(ended: Column, x: Column) -> tuple[Column, Column]:
        return F.when(x["own"], ended).otherwise(F.greatest(ended, x["end"])), marked(x, x["start"] >= ended)

    def leftwards(begun: Column, x: Column) -> tuple[Column, Column]:
        return F.when(x["own"], begun).otherwise(F.least(begun, x["start"])), marked(x, x["free"] & (x["end"] <= begun))

    def scan(both: Column) -> Column:
        there = running(both, F.lit(0), rightwards, kind)
        back = let(F.reverse(there), lambda r: running(r, F.lit(2**31 - 1), leftwards, kind))
        return F.transform(F.filter(F.reverse(back), lambda x: x["own"] & x["free"]), lambda x: x["s"])

    both = F.sort_array(F.concat(flag(base, False), flag(extra, True)))
    return F.when((F.size(extra) > 0) & (F.size(base) > 0), let(both, scan)).otherwise(extra)


def _votes(span: Column) -> Column:
    """The span with its labelers' votes: 1 for, -1 against, 0 abstains."""
    m, kind = span["match"], span["kind"]
    digits, value = F.regexp_replace(m, "[^0-9]", ""), F.regexp_replace(m, r"^\w+\x20{0,2}[:=]\x20{0,2}", "")
    strict = (
        F.when(kind.isin(*BASE, "hidden_email"), 1).when(kind == "local_phone", F.when(m.rlike(r"^\(?[2-9][0-9]{2}\D{0,2}[2-9]"), 1).otherwise(-1)).when(kind == "social", F.when(m.rlike(r"^(?:000|666|9)|-00-|-0000$"), -1).otherwise(1))
        .when(kind == "secret", F.when(value.rlike(r"[0-9]") & value.rlike("[A-Za-z]") & (F.length(value) >= 16), 1).otherwise(-1)).otherwise(0)
    )
    listed = F.when(kind == "titled_name", F.when(m.rlike(GIVEN), 1).otherwise(0)).when(kind == "secret", F.when(value.rlike(ISSUED), 1).otherwise(0)).otherwise(F.when(m.rlike(DOMAINS), 1).otherwise(0))
    votes = {
        "pattern": strict,
        "gazetteer": listed,
        "before": F.when(span["before"].rlike(AGAINST), -1).when(span["before"].rlike(CONTEXT), 1).otherwise(0),
        "after": F.when(span["after"].rlike(UNITS), -1).otherwise(0),
        "shape": F.when((F.length(digits) > 3) & digits.rlike(r"^(\d)\1*$"), -1).when((kind == "secret") & value.rlike(r"^[\"']?(?:[a-z]+|[A-Z]+|[0-9]+)[\"']?$"), -1).when((kind == "secret") & (F.length(value) >= 24), 1).otherwise(0),
    }
    return F.struct(kind.alias("kind"), span["start"].alias("start"), span["end"].alias("end"), *(v.cast("int").alias(k) for k, v in votes.items()))


def candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with BASE_SPANS and EXTRA_SPANS: arrays of spans with their votes."""
    t = F.coalesce(F.col(text), F.lit(""))

    def named(m: Column) -> Column:
        return F.when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "social").when(m.rlike(r"^[(0-9][0-9).\x20-]+$"), "local_phone").when(m.rlike(r"[(\[]at[)\]]"), "hidden_email").when(m.rlike("[:=]"), "secret").otherwise("titled_name")

    def kinds(spans: Column) -> Column:
        return F.transform(spans, lambda s: s.withField("kind", named(s["match"])))

    got = df.withColumn(BASE_SPANS, F.concat(*base_spans(t).values())).withColumn(EXTRA_SPANS, _spans(t, ANY_EXTRA, ""))
    got = got.withColumn(EXTRA_SPANS, kinds(apart(F.col(EXTRA_SPANS), F.col(BASE_SPANS))))
    return got.withColumns({c: F.transform(c, _votes) for c in (BASE_SPANS, EXTRA_SPANS)})


def learn(found: DataFrame, rounds: int = 30) -> dict[str, float]:
    """EM over the counts of vote patterns, then the span classifier's weights. ``found``: output of ``candidates``."""
    span = F.explode(F.concat(BASE_SPANS, EXTRA_SPANS)).alias("s")
    counts = found.select(span).groupBy("s.kind", *(f"s.{v}" for v in LABELERS)).count().collect()  # at most 9 x 3^5 rows
    rows = sorted(((r["kind"], *(r[v] for v in LABELERS)), r["count"]) for r in counts)
    if not rows:
        return {}
    post = [min(0.95, max(0.05, 0.5 + 0.2 * sum(p[1:]))) for p, _ in rows]
    for _ in range(rounds):
        total = sum(n for _, n in rows)
        prior = min(0.999, max(0.001, sum(q * n for q, (_, n) in zip(post, rows, strict=True)) / total))
        like = {}
        for j in range(1, len(LABELERS) + 1):
            for y in (0, 1):
                weight = [(q if y else 1 - q) * n for q, (_, n) in zip(post, rows, strict=True)]
                for v in (-1, 0, 1):
                    # pseudo-counts: a labeler's vote is taken to point the right way until the counts say otherwise
                    lean = 2.0 if v == (1 if y else -1) else 1.0
                    like[j, y, v] = (lean + sum(w for w, (p, _) in zip(weight, rows, strict=True) if p[j] == v)) / (4.0 + sum(weight))
        post = []
        for p, _ in rows:
            a = math.log(prior) + sum(math.log(like[j, 1, p[j]]) for j in range(1, len(p)))
            b = math.log(1 - prior) + sum(math.log(like[j, 0, p[j]]) for j in range(1, len(p)))
            post.append(1 / (1 + math.exp(min(50, max(-50, b - a)))))
    return _logistic(rows, post)


def features(kind: str, votes: tuple[int, ...]) -> list[str]:
    return ["bias", f"kind={kind}", *(f"{n}={v}" for n, v in zip(LABELERS, votes, strict=True))]


def _logistic(rows: list, post: list[float], steps: int = 400, ridge: float = 1e-2) -> dict[str, float]:
    """Ridge logistic regression on soft labels, by gradient steps over the patterns; counts enter by their logarithm."""
    weights: dict[str, float] = {}
    total = sum(math.log1p(n) for _, n in rows)
    for _ in range(steps):
        slope = {k: -ridge * w for k, w in weights.items()}
        for (p, n), q in zip(rows, post, strict=True):
            names = features(p[0], p[1:])
            z = sum(weights.get(f, 0.0) for f in names)
            error = (q - 1 / (1 + math.exp(-z))) * math.log1p(n) / total
            for f in names:
                slope[f] = slope.get(f, 0.0) + error
        for f, s in slope.items():
            weights[f] = weights.get(f, 0.0) + 2.0 * s
    return weights


def _accepted(span: Column, model: dict[str, float], threshold: float) -> Column:
    score = F.lit(model.get("bias", 0.0))
    for kind in KINDS:
        score = score + F.when(span["kind"] == kind, model.get(f"kind={kind}", 0.0)).otherwise(0.0)
    for name in LABELERS:
        for v in (-1, 0, 1):
            score = score + F.when(span[name] == v, model.get(f"{name}={v}", 0.0)).otherwise(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score)) > threshold


def of_kind(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def spans(found: DataFrame, model: dict[str, float], threshold: float = 0.5) -> DataFrame:
    """``candidates`` output with ALL_SPANS: base ones by kind and start, then the accepted ones by kind and start."""
    slim = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    added = [F.transform(F.filter(of_kind(EXTRA_SPANS, k), lambda s: _accepted(s, model, threshold)), slim) for k in EXTRA] if model else []
    return found.withColumn(ALL_SPANS, F.concat(F.transform(BASE_SPANS, slim), *added))


def without(text: Column, found: Column) -> Column:
    """``text`` with the kind of each of the spans in its place; of spans that overlap the first one's, once."""
    kind = "array<struct<from:int,start:int,kind:string,fresh:boolean>>"

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        return F.greatest(at, s["end"]), F.struct(at.alias("from"), s["start"].alias("start"), s["kind"].alias("kind"), (s["start"] >= at).alias("fresh"))

    def between(blocks: Column, a: Column, b: Column) -> Column:
        p, q = F.floor(a / CUT).cast("int"), F.floor(b / CUT).cast("int")
        block = lambda i: F.coalesce(F.get(blocks, i), F.lit(""))
        apart_ = F.concat(F.substring(block(p), a % CUT + 1, F.lit(CUT)), F.array_join(F.slice(blocks, p + 2, q - p - 1), ""), F.substring(block(q), F.lit(1), b % CUT))
        return F.when(p == q, F.substring(block(p), a % CUT + 1, b - a)).otherwise(apart_)

    def cut(order: Column, blocks: Column) -> Column:
        marks = F.filter(running(order, F.lit(0), step, kind), lambda m: m["fresh"])
        head = F.array_join(F.transform(marks, lambda m: F.concat(between(blocks, m["from"], m["start"]), F.lit("<"), F.upper(m["kind"]), F.lit(">"))), "")
        return F.concat(head, between(blocks, F.array_max(F.transform(order, lambda s: s["end"])), F.length(text)))

    order = F.sort_array(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))
    return F.when(F.size(found) > 0, let(order, lambda o: let(blocks, lambda b: cut(o, b)))).otherwise(text)


def redact(df: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``df`` with every span in ``text`` replaced by its kind in angle brackets; spans that overlap become one."""

    def use(plain: DataFrame) -> DataFrame:
        found = saved(candidates(plain, text), "pii")
        got = spans(found, learn(found), threshold)
        return got.withColumn(text, without(F.col(text), F.col(ALL_SPANS))).select(*plain.columns)

    return aside(df, (text,), use)


def digests(docs: DataFrame) -> DataFrame:
    found = saved(candidates(docs.select("doc_id", "text")).drop("text"), "pii")
    got = spans(found, learn(found))
    name = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    counts = [F.size(of_kind(BASE_SPANS, k)).cast("long").alias(f"n_{k}") for k in BASE]
    return got.select("doc_id", *counts, F.sha2(F.array_join(F.transform(BASE_SPANS, name), ","), 256).alias("base_sha256"), F.array_join(F.transform(ALL_SPANS, name), ",").alias("spans"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
