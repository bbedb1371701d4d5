"""Features of verdicts from token log-probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A class without a log-probability; what its log-probability is shown as.
MISSING, SHOWN = -100.0, -10.0
LN2, LN3 = 0.6931471805599453, 1.0986122886681098

# The tokens, trimmed and lower-cased, that tell a verdict.
YES_TOKENS = ("yes", "y", "true", "t")
NO_TOKENS = ("no", "n", "false", "f")
UNSURE_TOKENS = ("unsure", "uncertain", "unknown", "un", "uns", "uncert")
# The same for collectors, whose answers are JSON; a lone quote is a place of decision, too.
JSON_YES_TOKENS = ("true", "true}")
JSON_NO_TOKENS = ("false", "false}")
JSON_UNSURE_TOKENS = ("unsure", '"unsure"', 'unsure"', '"unsure', "unsure}")


def class_of(token: Column, three: bool = True) -> Column:
    """yes, no or unsure by a token's text; null for other tokens."""
    t = F.lower(F.trim(token))
    out = F.when(t.isin(*YES_TOKENS), "yes").when(t.isin(*NO_TOKENS), "no")
    return out.when(t.isin(*UNSURE_TOKENS), "unsure") if three else out


def _json_class(token: Column) -> Column:
    t = F.lower(F.trim(token))
    return F.when(t.isin(*JSON_YES_TOKENS), "yes").when(t.isin(*JSON_NO_TOKENS), "no").when(t.isin(*JSON_UNSURE_TOKENS), "unsure")


def scan(content: Column, three: bool = True) -> Column:
    """Log-probabilities of the classes at the first decision token.

    content: array<struct<token, logprob, top: array<struct<token, logprob>>>>. The decision token
    is the first that has a class itself or among its alternatives; the largest value of a class counts.
    """
    all_of = lambda p: F.concat(F.array(F.struct(p["token"].alias("token"), p["logprob"].alias("logprob"))), F.coalesce(p["top"], F.array()))
    decides = F.filter(content, lambda p: F.exists(all_of(p), lambda t: class_of(t["token"], three).isNotNull()))
    at = F.get(decides, F.lit(0))
    names = ("yes", "no", "unsure") if three else ("yes", "no")

    def best(name: str) -> Column:
        own = F.filter(all_of(at), lambda t: class_of(t["token"], three) == name)
        return F.coalesce(F.array_max(F.transform(own, lambda t: t["logprob"].cast("double"))), F.lit(MISSING))

    return F.when(at.isNotNull(), F.struct(*[best(n).alias(n) for n in names]))


def collector_scan(content: Column) -> Column:
    """As scan, for collectors: the first place whose own token is a verdict or a quote decides; null for classes not seen there."""
    decides = F.filter(content, lambda p: _json_class(p["token"]).isNotNull() | (F.trim(p["token"]) == '"'))
    at = F.get(decides, F.lit(0))
    seen = F.concat(F.array(F.struct(at["token"].alias("token"), at["logprob"].alias("logprob"))), F.coalesce(at["top"], F.array()))
    best = lambda name: F.array_max(F.transform(F.filter(seen, lambda t: _json_class(t["token"]) == name), lambda t: t["logprob"].cast("double")))
    return F.struct(*[F.when(at.isNotNull(), best(n)).alias(n) for n in ("yes", "no", "unsure")])


def plain_content(raw: list | None) -> list[dict]:
    """A client's log-probabilities as token, logprob, top; null and missing fields are left empty."""
    get = lambda o, k: o.get(k) if isinstance(o, dict) else getattr(o, k, None)
    one = lambda o: {"token": get(o, "token") or "", "logprob": float(get(o, "logprob") if get(o, "logprob") is not None else MISSING)}
    return [{**one(x), "top": [one(t) for t in get(x, "top_logprobs") or []]} for x in raw or []]


def _entropy(*p: Column) -> Column:
    out = F.lit(0.0)
    for x in p:
        out = out - F.when(x > 1e-10, x * F.log(F.greatest(x, F.lit(1e-300)))).otherwise(0.0)
    return out


def _seen(*lp: Column) -> Column:
    """Whether any class has a log-probability."""
    out = F.lit(False)
    for c in lp:
        out = out | F.coalesce(c > MISSING, F.lit(False))
    return out


def _shown(known: Column, **lp: Column) -> list[Column]:
    value = lambda c: F.when(known & (c > MISSING), c).otherwise(SHOWN)
    return [known.alias("logprobs_available"), *[F.coalesce(value(c), F.lit(SHOWN)).alias(f"logprob_{n}") for n, c in lp.items()]]


def features_2way(yes: Column, no: Column, text_verdict: Column) -> Column:
    """Struct of verdict, confidence, p_yes, p_no, margin, entropy; without log-probabilities from the text alone."""
    known = _seen(yes, no)
    y, n = F.coalesce(yes, F.lit(MISSING)), F.coalesce(no, F.lit(MISSING))
    top = F.greatest(y, n)
    ey, en = F.when(y > MISSING, F.exp(y - top)).otherwise(0.0), F.when(n > MISSING, F.exp(n - top)).otherwise(0.0)
    py = F.when(known, ey / F.greatest(ey + en, F.lit(1e-300))).otherwise(0.5)
    pn = F.when(known, en / F.greatest(ey + en, F.lit(1e-300))).otherwise(0.5)
    return F.struct(
        *_shown(known, yes=yes, no=no),
        F.when(known, F.when(py >= pn, "Yes").otherwise("No")).otherwise(text_verdict).alias("prediction"),
        F.when(known, F.greatest(py, pn)).otherwise(1.0).alias("confidence"),
        py.alias("p_yes"), pn.alias("p_no"), F.abs(py - pn).alias("margin"),
        F.when(known, _entropy(py, pn)).otherwise(LN2).alias("entropy"),
    )


def features_3way(yes: Column, no: Column, unsure: Column, text_verdict: Column) -> Column:
    """Struct of verdict, confidence (the larger of p_yes and p_no), three shares, margin, both entropies."""
    known = _seen(yes, no, unsure)
    lp = [F.coalesce(c, F.lit(MISSING)) for c in (yes, no, unsure)]
    top = F.greatest(*lp)
    e = [F.when(c > MISSING, F.exp(c - top)).otherwise(0.0) for c in lp]
    total = F.greatest(e[0] + e[1] + e[2], F.lit(1e-300))
    hot = [F.when(text_verdict == v, 1.0).otherwise(0.0) for v in ("Yes", "No", "Unsure")]
    py, pn, pu = (F.when(known, x / total).otherwise(h) for x, h in zip(e, hot, strict=True))
    pair = py + pn
    two = F.when(pair > 0, _entropy(py / F.greatest(pair, F.lit(1e-300)), pn / F.greatest(pair, F.lit(1e-300)))).otherwise(LN2)
    verdict = F.when((py >= pn) & (py >= pu), "Yes").when(pn >= pu, "No").otherwise("Unsure")
    return F.struct(
        *_shown(known, yes=yes, no=no, unsure=unsure),
        F.when(known, verdict).otherwise(text_verdict).alias("prediction"),
        F.when(known, F.greatest(py, pn)).otherwise(1.0).alias("confidence"),
        py.alias("p_yes"), pn.alias("p_no"), pu.alias("p_unsure"),
        F.when(known, F.abs(py - pn)).otherwise(0.0).alias("margin"),
        F.when(known, two).otherwise(LN2).alias("entropy_2way"),
        F.when(known, _entropy(py, pn, pu)).otherwise(LN3).alias("entropy_3way"),
    )


def legacy(features: Column, raw: Column) -> Column:
    """Verdict, confidence and text alone; without log-probabilities the confidence is 1."""
    return F.struct(features["prediction"].alias("prediction"), features["confidence"].alias("confidence"), raw.alias("raw"))


def collector_features(yes: Column, no: Column, unsure: Column, verdict: Column) -> Column:
    """Shares and entropy in bits as offline collectors write them: one class alone is certain, none is a third each.

    confidence is the share of the verdict read from the text (Yes, No, unsure), and the largest share where that failed.
    """
    lp = [F.when(c > MISSING, c) for c in (yes, no, unsure)]
    some = sum((c.isNotNull().cast("int") for c in lp), F.lit(0))
    top = F.greatest(*lp)
    e = [F.coalesce(F.exp(c - top), F.lit(0.0)) for c in lp]
    total = F.greatest(e[0] + e[1] + e[2], F.lit(1e-300))
    p = [F.when(some == 0, 1.0 / 3.0).otherwise(x / total) for x in e]
    own = F.when(verdict == "Yes", p[0]).when(verdict == "No", p[1]).when(F.lower(verdict) == "unsure", p[2]).otherwise(F.greatest(*p))
    return F.struct(p[0].alias("p_true"), p[1].alias("p_false"), p[2].alias("p_unsure"), own.alias("confidence"), (_entropy(*p) / LN2).alias("entropy"))


def renormalised_entropy(p_yes: Column, p_no: Column) -> Column:
    """Binary entropy of the pair in nats; ln 2 if either is missing."""
    y = F.greatest(p_yes, F.lit(1e-9)) / (F.greatest(p_yes, F.lit(1e-9)) + F.greatest(p_no, F.lit(1e-9)))
    return F.when(p_yes.isNull() | p_no.isNull(), LN2).otherwise(-(y * F.log(y) + (1 - y) * F.log(1 - y)))


def clipped_sigmoid(x: Column, eps: float = 1e-6) -> Column:
    return F.least(F.greatest(1 / (1 + F.exp(-x)), F.lit(eps)), F.lit(1 - eps))


def agreement(small: Column, large: Column) -> Column:
    """1 if the models agree, 0 if not or if either is undecided, null if either is missing."""
    vague = ("UNKNOWN", "Unsure")
    return F.when(small.isNull() | large.isNull(), None).when(small.isin(*vague) | large.isin(*vague), 0).otherwise((small == large).cast("int"))
