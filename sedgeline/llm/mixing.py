"""Mixing documents to target weights of domains that are only known softly.

1. A naive Bayes classifier is counted from a labelled table (id, domain): its features are
   binned surface measures of a text and whether it holds a word of a domain's lexicon. The
   lexicons are the words most tied to each domain (chi-square) in at most
   ``MAX_LEXICON_ROWS`` labelled texts, picked by a hash of the id: ``LEXICON`` words of a domain at most, with a chi-square of
   ``SIGNIFICANT`` or more, each in 5 of these texts. Counts are per (domain, feature, bin).
2. Documents with equal bins have equal posteriors and form one cell; cells are few whatever
   the corpus, and keep the number of their documents and tokens.
3. Rates r >= 0 per document, at most ``max_rate``, minimise the weighted squares of expected
   domain tokens less targets, sum over d of (S_d - T_d)**2 / M_d, where S_d adds up
   rate * tokens * posterior and M_d is S_d at rate 1. Projected gradient descent does it: every
   round is one aggregation over the cells, r <- clip(r - sum over d of p_d * (S_d - T_d) / M_d).
   In this scaling the step 1 always converges.
4. A document is taken floor(rate + u) times, u being uniform by a hash of id and text.

Tokens are runs of letters and digits. Targets: weights times a budget of tokens. Without a budget it is what lets the domain of largest
weight keep all its tokens at rate 1.

Native throughout: DataFrame and SQL expressions only.

Defined cases: null and empty texts have no tokens and keep rate and posterior of their bins; labels
with a null or unknown domain are not used; an id labelled more than once counts for each of its
labels. Without any labelled document posteriors are equal for all domains. An empty table gives no rows.
A negative or zero sum of weights is an error. Result columns replace columns of those names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, small

MAX_LEXICON_ROWS, LEXICON, SIGNIFICANT = 12_000, 40, 30.0
ROUNDS, CLOSE = 60, 1e-4
_TERM = r"\p{L}[\p{L}\p{N}]{2,}"

RESULT = ("n_tokens", "posteriors", "rate", "copies")

#: Characters that count as symbols.
SYMBOLS = "#%$&*|!@~^+=<>"
#: Upper ends of the bins of each surface measure.
BINS = {
    "symbols": (0.001, 0.02, 0.05, 0.1, 0.2, 0.4),
    "upper": (0.02, 0.05, 0.1, 0.3, 0.6),
    "digits": (0.001, 0.01, 0.05, 0.2),
    "word_length": (3.0, 4.0, 5.0, 6.0, 8.0, 12.0),
    "tokens": (10, 30, 100, 300, 1000, 3000),
}


def _bin(x: Column, ends: tuple) -> Column:
    out = F.lit(0)
    for e in ends:
        out = out + (x > e).cast("int")
    return out


def _runs(text: Column) -> Column:
    """What stands between the characters that are neither letter nor digit; the ends may be empty."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1)


def _tokens(runs: Column) -> Column:
    """Number of runs of letters and digits."""
    return (F.size(runs) - (F.element_at(runs, 1) == "").cast("int") - ((F.size(runs) > 1) & (F.element_at(runs, -1) == "")).cast("int")).cast("long")


def _bins(text: Column, runs: Column, n_tokens: Column, lexicons: dict[str, list[str]]) -> Column:
    """The bins of a text: the surface measures, then one flag per lexicon."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.octet_length(t), F.lit(1)).cast("double")
    symbols = F.lit(0)
    for c in SYMBOLS:
        symbols = symbols + F.octet_length(t) - F.octet_length(F.replace(t, F.lit(c)))
    measures = {
        "symbols": symbols / n,
        "upper": F.octet_length(F.regexp_replace(t, r"[^A-Z]+", "")) / n,
        "digits": F.octet_length(F.regexp_replace(t, r"[^0-9]+", "")) / n,
        "word_length": n / F.greatest(n_tokens, F.lit(1)),
        "tokens": n_tokens,
    }
    flags = [F.arrays_overlap(runs, F.array(*(F.lit(w) for w in words))).cast("int") if words else F.lit(0) for words in lexicons.values()]
    return F.array(*(_bin(measures[m], BINS[m]) for m in BINS), *flags)


def _lexicons(docs: DataFrame, labelled: DataFrame, domains: list[str], id: str, text: str) -> dict[str, list[str]]:
    """Per domain the words most tied to it among a bounded number of labelled texts."""
    picked = labelled.orderBy(F.xxhash64("id", F.lit(3)), "id", "domain").limit(MAX_LEXICON_ROWS)
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).join(F.broadcast(picked), "id").where("text is not null")
    # copies of a text count once for each domain
    once = rows.groupBy(F.xxhash64("text").alias("h"), "domain").agg(F.min("id").alias("id")).select("id", "domain").collect()
    if not once:
        return {d: [] for d in domains}
    once = docs.sparkSession.createDataFrame([(r["id"], r["domain"]) for r in once], "id long, domain string")
    total = {r["domain"]: r["n"] for r in once.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    n = float(sum(total.values()))
    # of an id with several texts the least counts
    rows = rows.groupBy("id").agg(F.min("text").alias("text")).join(F.broadcast(once), "id")
    term = F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(_TERM), F.lit(0)), F.lower))).alias("term")
    df = rows.select("domain", term).groupBy("term").agg(F.count("*").alias("all"), *(F.count(F.when(F.col("domain") == d, 1)).alias(f"d{i}") for i, d in enumerate(domains))).where("all >= 5")
    out = {}
    for i, d in enumerate(domains):
        m = float(total.get(d, 0))
        a, s = F.col(f"d{i}"), F.col("all")
        chi = n * F.pow(a * (n - m) - (s - a) * m, 2) / F.greatest(F.lit(1.0), s * (n - s) * m * (n - m))
        best = df.where((a * n > s * m) & (chi >= SIGNIFICANT)).orderBy(chi.desc(), "term").limit(LEXICON).select("term").collect() if 0 < m < n else []
        out[d] = [r["term"] for r in best]
    return out


def _literal(values: list[float]) -> Column:
    return F.expr(f"array({','.join(f'{float(v)!r}D' for v in values)})")


def _posteriors(bins: Column, domains: list[str], counts: dict, totals: dict[str, int], sizes: list[int]) -> Column:
    """Array of the domains' posteriors, from counts[(domain, feature, bin)] with add-one smoothing."""
    n = sum(totals.values())
    scores = []
    for d in domains:
        s = F.lit(math.log((totals.get(d, 0) + 1) / (n + len(domains))))
        for f, size in enumerate(sizes):
            logs = [math.log((counts.get((d, f, b), 0) + 1) / (totals.get(d, 0) + size)) for b in range(size)]
            s = s + F.get(_literal(logs), bins[f])
        scores.append(s)
    raw = F.array(*scores)
    top = F.array_max(raw)
    powers = F.transform(raw, lambda s: F.exp(s - top))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, x: a + x))


def _dot(p: Column, g: Column) -> Column:
    return F.aggregate(F.zip_with(p, g, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)


def _rate(p: Column, history: list[list[float]], max_rate: float) -> Column:
    """The rate after the rounds so far: each round's gradient is its scaled residual times the posterior."""
    if not history:
        return F.lit(min(1.0, max_rate))
    steps = F.expr("array(" + ",".join("array(" + ",".join(f"{v!r}D" for v in g) + ")" for g in history) + ")")
    return F.aggregate(steps, F.lit(min(1.0, max_rate)), lambda r, g: F.least(F.lit(float(max_rate)), F.greatest(F.lit(0.0), r - _dot(p, g))))


def mix(
    docs: DataFrame,
    labelled: DataFrame,
    targets: dict[str, float],
    *,
    budget: float | None = None,
    max_rate: float = 4.0,
    id: str = "doc_id",
    text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` (all, by default) of ``docs`` with ``n_tokens``, ``posteriors`` (in the order of ``targets``), ``rate`` and ``copies``.

    ``labelled``: (id, domain). ``targets``: weights of the domains, in any unit.
    """
    if sum(targets.values()) <= 0 or min(targets.values()) < 0:
        raise ValueError("targets must be weights of at least 0 with a positive sum")
    scratch = Scratch(docs.sparkSession, "mix")
    domains = list(targets)
    share = {d: w / sum(targets.values()) for d, w in targets.items()}
    known = labelled.where(F.col("id").isNotNull() & F.col("domain").isin(domains)).select(F.col("id").cast("long").alias("id"), "domain").distinct()
    known = scratch.put(known)
    lexicons = _lexicons(docs, known, domains, id, text)

    cols = [c for c in (docs.columns if keep is None else keep) if c not in RESULT]
    u = (F.pmod(F.xxhash64(F.col(id).cast("long"), F.col(text), F.lit(41)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    measured = docs.select(*cols, F.col(id).cast("long").alias("_sl_id"), F.col(text).alias("_sl_text"), _runs(F.col(text)).alias("_sl_runs"), u.alias("_sl_u"))
    measured = measured.withColumn("n_tokens", _tokens(F.col("_sl_runs")))
    measured = measured.withColumn("_sl_bins", _bins(F.col("_sl_text"), F.col("_sl_runs"), F.col("n_tokens"), lexicons)).drop("_sl_text", "_sl_runs")
    if text in cols:
        narrow = scratch.put(measured.select("_sl_id", "n_tokens", "_sl_bins"))
    else:
        narrow = measured = scratch.put(measured)

    sizes = [*(len(e) + 1 for e in BINS.values()), *(2 for _ in domains)]
    seen = narrow.select(F.col("_sl_id").alias("id"), "_sl_bins").join(small(known), "id")
    counted = seen.select("domain", F.posexplode("_sl_bins").alias("f", "b")).groupBy("domain", "f", "b").agg(F.count("*").alias("n")).collect()
    counts = {(r["domain"], r["f"], r["b"]): r["n"] for r in counted}
    totals = {d: sum(n for (e, f, _), n in counts.items() if e == d and f == 0) for d in domains}
    posteriors = _posteriors(F.col("_sl_bins"), domains, counts, totals, sizes)

    cells = narrow.groupBy("_sl_bins").agg(F.sum("n_tokens").cast("double").alias("n"))
    # a bounded table (cells of bins), in one part: its aggregations need no shuffle
    cells = scratch.put(cells.select("_sl_bins", posteriors.alias("p"), "n"), 1).coalesce(1)
    mass = cells.agg(*(F.coalesce(F.sum(F.col("p")[i] * F.col("n")), F.lit(0.0)) for i in range(len(domains)))).first()
    largest = max(range(len(domains)), key=lambda i: share[domains[i]])
    total = float(budget) if budget is not None else mass[largest] / share[domains[largest]]
    goal = [share[d] * total for d in domains]
    history: list[list[float]] = []
    for _ in range(ROUNDS):
        rate = _rate(F.col("p"), history, max_rate)
        got = cells.select("p", (F.col("n") * rate).alias("n")).agg(*(F.coalesce(F.sum(F.col("p")[i] * F.col("n")), F.lit(0.0)) for i in range(len(domains)))).first()
        step = [(s - t) / m if m > 0 else 0.0 for s, t, m in zip(got, goal, mass, strict=True)]
        if history and max(abs(a - b) for a, b in zip(step, history[-1], strict=True)) < CLOSE:
            break
        history.append(step)
    # rate and posteriors are those of a row's cell: looked up, not computed again for every row
    fitted = scratch.put(cells.select("_sl_bins", F.col("p").alias("posteriors"), _rate(F.col("p"), history, max_rate).alias("rate")))
    out = measured.join(F.broadcast(fitted), "_sl_bins")
    return out.select(*cols, "n_tokens", "posteriors", "rate", F.floor(F.col("rate") + F.col("_sl_u")).cast("int").alias("copies"))


def take(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], **options) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` says."""
    clash = {c: f"_sl_own_{c}" for c in docs.columns if c in RESULT}
    mixed = mix(docs.withColumnsRenamed(clash), labelled, targets, **options)
    own = [F.col(clash.get(c, c)).alias(c) for c in docs.columns]
    return mixed.where("copies > 0").withColumn("_sl_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*own)
