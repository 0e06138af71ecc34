"""Secrets in texts: three fixed patterns, and strings that look random to Markov models.

DataFrame functions only. Positions count code points, ends are exclusive.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.common import staged

# The base patterns with their kinds in order, and the least length of a finding.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "markov")
LEAST = {"assign": 8, "access": 16, "hex": 32}

# What the models judge: runs of the characters of keys, long enough to tell, and parts of such runs.
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
PART = r"[A-Za-z0-9]{16,}"
# Words from which the ordinary model learns how letters follow each other.
WORDS = r"[A-Za-z]{10,}"
# Alphabets of which keys are made; the random model learns from strings drawn of each.
ALPHABETS = (
    "0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdefghijklmnopqrstuvwxyz",
    "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
)
DRAWN, DRAWN_LENGTHS = 2_000, (16, 64)
# Lengths from which on strings have a threshold of their own: the longer, the surer a mean is.
LENGTHS = (16, 20, 24, 32, 48)
_CODES = 128
# Mean ratio of a pair from which on odds are clear, and the steps in which ratios are counted.
CLEAR, STEPS = 0.15, 50
BLOCK = 64
CHUNK = 4096


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where lambdas use it often."""
    return F.get(F.transform(F.array(value), body), 0)


def running(values: Column, combine, zero: Column) -> Column:
    """Running totals of an array: inside blocks, after the totals of the blocks before.

    Appending to an array copies it, so one pass over all would grow with the square.
    """
    extended = lambda start, array: F.aggregate(array, F.array(start), lambda a, x: F.concat(a, F.array(combine(F.element_at(a, -1), x))))
    numbers = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / BLOCK).cast("int") - 1, F.lit(0)))
    blocks = let(values, lambda v: F.transform(numbers, lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK))))

    def joined(blocks: Column) -> Column:
        heads = extended(zero, F.transform(blocks, lambda b: F.aggregate(b, zero, combine)))
        return F.flatten(F.zip_with(blocks, F.slice(heads, F.lit(1), F.size(blocks)), lambda b, head: F.slice(extended(head, b), F.lit(2), F.greatest(F.size(b), F.lit(0)))))

    return let(blocks, joined)


SPANS = "array<struct<start:int,end:int,value:string>>"


def _pieces(text: Column, pattern: str, group: int) -> Column:
    return F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )


def _found(text: Column, pattern: str, when: Column, value_group: int, least: int) -> Column:
    """Matches of ``pattern`` as structs (start, end, value), those with a short value dropped.

    The text between the matches and the matches themselves give the positions.
    """

    def placed(pieces: Column) -> Column:
        size = lambda c: F.coalesce(F.length(c), F.lit(0))
        ends = running(F.transform(pieces, lambda p: size(p["gap"]) + size(p["hit"])), lambda a, x: a + x, F.lit(0))
        spans = F.zip_with(pieces, ends, lambda p, end: F.struct((end - size(p["hit"])).alias("start"), end.alias("end"), p["value"].alias("value")))
        return F.filter(spans, lambda s: F.coalesce(F.length(s["value"]) >= least, F.lit(False)))

    found = F.when(when, let(_pieces(text, pattern, value_group), placed))
    return F.coalesce(found.cast(SPANS), F.array().cast(SPANS))


def _blanked(text: Column, pattern: str, group: int, least: int) -> Column:
    """The text with its findings as blanks of the same length."""
    blank = lambda p: F.when(F.length(p["value"]) >= least, F.repeat(F.lit(" "), F.length(p["hit"]))).otherwise(F.coalesce(p["hit"], F.lit("")))
    return F.array_join(F.transform(_pieces(text, pattern, group), lambda p: F.concat(p["gap"], blank(p))), "")


def base_spans(text: Column) -> dict[str, Column]:
    """Findings of each base kind in a text without nulls."""
    return {
        "assign": _found(text, ASSIGN, text.rlike(ASSIGN), 2, LEAST["assign"]),
        "access": _found(text, ACCESS, text.contains("AKIA"), 0, LEAST["access"]),
        # A shorter run cannot be part of a longer one, so its length may be part of the pattern.
        "hex": _found(text, HEX[:-1] + "{32,}", text.rlike(HEX[:-1] + "{32,}"), 0, LEAST["hex"]),
    }


def _merged(base: dict[str, Column]) -> Column:
    """Base findings as one array of structs (start, kind, end), by start and kind."""
    return F.array_sort(F.concat(*[_of_kind(spans, k) for k, spans in enumerate(base.values())]))


def _of_kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def scan(docs: DataFrame, *keep: Column) -> DataFrame:
    """doc_id, base findings (assign, access, hex, and all in ``base``), the candidates and
    long words beside them, and the columns to ``keep``. Null texts count as empty."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"), *keep)
    kept = [c for c in rows.columns if c not in ("doc_id", "_text")]
    rows = rows.select("*", *[spans.alias(kind) for kind, spans in base_spans(F.col("_text")).items()])
    rows = rows.withColumn("base", _merged({k: F.col(k) for k in LEAST}))
    rest = F.col("_text")
    for kind, pattern, group in (("assign", ASSIGN, 2), ("access", ACCESS, 0), ("hex", HEX[:-1] + "{32,}", 0)):
        rest = F.when(F.size(kind) > 0, _blanked(rest, pattern, group, LEAST[kind])).otherwise(rest)
        rows = rows.withColumn("_rest", rest)
        rest = F.col("_rest")
    runs = _found(rest, CANDIDATE, rest.rlike(CANDIDATE), 0, 1)
    words = F.array_distinct(F.regexp_extract_all(rest, F.lit(WORDS), F.lit(0)))
    return rows.select("doc_id", *LEAST, "base", runs.alias("candidates"), words.alias("words"), *kept)


class Models(NamedTuple):
    """Log-likelihood ratio of each pair of characters, and by length the mean from which on a string counts as random."""

    ratios: str
    thresholds: tuple[float, ...]

    def mean_ratio(self, value: Column) -> Column:
        table = F.split(F.lit(self.ratios), ",").cast("array<double>")
        ratio = lambda a, b: F.element_at(table, F.ascii(a) * _CODES + F.ascii(b) + 1)
        total = lambda chars: F.aggregate(F.sequence(F.lit(1), F.size(chars) - 1), F.lit(0.0), lambda t, i: t + ratio(F.get(chars, i - 1), F.get(chars, i)))
        return let(F.split(value, ""), total) / (F.length(value) - 1)

    def random(self, value: Column) -> Column:
        return self.mean_ratio(value) > F.get(F.array(*[F.lit(t) for t in self.thresholds]), length_class(value))


def length_class(value: Column) -> Column:
    return sum(((F.length(value) >= n).cast("int") for n in LENGTHS[1:]), F.lit(0))


def drawn_strings(docs: DataFrame) -> DataFrame:
    """(value): DRAWN strings of each key alphabet, of all lengths, the same on every run."""
    low, high = DRAWN_LENGTHS
    draw = lambda *parts, n: F.pmod(F.xxhash64(*parts), F.lit(n)).cast("int")
    letters = F.get(F.array(*map(F.lit, ALPHABETS)), F.col("kind"))
    rows = docs.sparkSession.range(DRAWN * len(ALPHABETS)).withColumn("kind", (F.col("id") % len(ALPHABETS)).cast("int"))
    size = low + draw(F.col("id"), F.lit("size"), n=high - low + 1)
    picked = F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(letters, F.pmod(F.xxhash64(F.col("id"), i), F.length(letters)).cast("int") + 1, F.lit(1)))
    return rows.select(F.array_join(picked, "").alias("value"))


KEY, WORD, RUN = "key", "word", "run"


def _samples(scanned: DataFrame) -> DataFrame:
    """Labelled strings, each once: values of base findings and drawn ones are keys, then long words and numbers, and candidates."""
    secrets = F.concat(*[F.transform(k, lambda s: s["value"]) for k in LEAST])
    runs = F.transform("candidates", lambda c: c["value"])
    marked = F.concat(*[F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))) for kind, values in ((KEY, secrets), (WORD, F.col("words")), (RUN, runs))])
    found = scanned.select(F.explode(marked).alias("s")).select("s.kind", "s.value").where(F.length("value") > 1)
    # Numbers are no keys, whoever wrote them.
    number = (F.col("kind") == RUN) & F.col("value").rlike("^[0-9]+$")
    found = found.withColumn("kind", F.when(number, WORD).otherwise(F.col("kind")))
    return found.distinct().unionByName(drawn_strings(scanned).select(F.lit(KEY).alias("kind"), "value"))


def _pair_counts(samples: DataFrame) -> dict[str, dict[str, int]]:
    """Counts of adjacent characters by kind: at most 128 x 128 of each."""
    pairs = let(F.split("value", ""), lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.concat(F.get(c, i - 1), F.get(c, i))))
    counts: dict[str, dict[str, int]] = {KEY: {}, WORD: {}, RUN: {}}
    for r in samples.select("kind", F.explode(pairs).alias("pair")).groupBy("kind", "pair").count().collect():
        if all(33 <= ord(c) < 127 for c in r["pair"]):
            counts[r["kind"]][r["pair"]] = r["count"]
    return counts


def _ratios(keys: dict[str, int], ordinary: dict[str, int]) -> Models:
    random, plain = pair_logs(keys), pair_logs(ordinary)
    table = [0.0] * (_CODES * _CODES)
    for p in random:
        table[ord(p[0]) * _CODES + ord(p[1])] = random[p] - plain[p]
    return Models(",".join(f"{v:.5f}" for v in table), ())


def pair_logs(counts: dict[str, int]) -> dict[str, float]:
    """Log probability of each character after another, from counts of pairs."""
    alphabet = [chr(c) for c in range(33, 127)]
    rows, columns = dict.fromkeys(alphabet, 0), dict.fromkeys(alphabet, 0)
    for pair, n in counts.items():
        rows[pair[0]] += n
        columns[pair[1]] += n
    # The spread of unseen pairs follows what the model has seen of each character.
    total = sum(counts.values()) + len(alphabet)
    share = {b: (columns[b] + 1) / total for b in alphabet}
    return {a + b: math.log((counts.get(a + b, 0) + 8 * share[b]) / (rows[a] + 8)) for a in alphabet for b in alphabet}


def place_threshold(ordinary: dict[int, int], random: dict[int, int]) -> float:
    """The step between the two where the shares of both on the wrong side add up to the least."""
    if not random:
        return math.inf
    steps = range(round(CLEAR * STEPS), max([*ordinary, *random, round(CLEAR * STEPS)]) + 2)
    above, below = sum(ordinary.values()), sum(random.values())
    wrong = {t: sum(n for s, n in ordinary.items() if s >= t) / max(above, 1) + sum(n for s, n in random.items() if s < t) / below for t in steps}
    best = min(wrong.values())
    flat = [t for t in steps if wrong[t] <= best + 1e-9]
    return (flat[0] + flat[-1] + 1) / 2 / STEPS


def train(scanned: DataFrame) -> Models:
    """First-order models of random and ordinary strings from labelled samples, and
    thresholds between the two, one per class of lengths.

    The random model learns from the base findings of all documents and from strings
    drawn evenly of the alphabets of keys. The ordinary one learns from all long words and
    numbers, then also from the candidates which those two models take for ordinary: some
    candidates are keys that no pattern knows, and must not teach the ordinary model.
    Pairs and rounded ratios are counted with partial sums: at most 128 x 128 counts a
    model, and a few hundred steps per class of lengths, reach the driver.
    """
    samples = staged(_samples(scanned), "secret-samples")
    counts = _pair_counts(samples)
    first = _ratios(counts[KEY], counts[WORD] or counts[RUN])
    labelled = samples.withColumn("kind", F.when((F.col("kind") == RUN) & (first.mean_ratio(F.col("value")) < 0), WORD).otherwise(F.col("kind")))
    labelled = staged(labelled.where(F.col("kind") != RUN), "secret-labels")
    counts = _pair_counts(labelled)
    models = _ratios(counts[KEY], counts[WORD])
    step = F.floor(models.mean_ratio(F.col("value")) * STEPS).cast("int")
    judged = labelled.where(F.length("value") >= LENGTHS[0]).select("kind", length_class(F.col("value")).alias("class"), step.alias("step"))
    keys: dict[int, dict[int, int]] = {}
    ordinary: dict[int, int] = {}
    for r in judged.groupBy("kind", "class", "step").count().collect():
        if r["kind"] == KEY:
            keys.setdefault(r["class"], {})[r["step"]] = r["count"]
        else:  # of all lengths together: long ones may be few
            ordinary[r["step"]] = ordinary.get(r["step"], 0) + r["count"]
    return models._replace(thresholds=tuple(place_threshold(ordinary, keys.get(c, {})) for c in range(len(LENGTHS))))


def _random(models: Models) -> Column:
    """Candidates that look random; of the others, their parts between / + = _ and - that do."""

    def parts(c: Column) -> Column:
        found = _found(c["value"], PART, F.lit(True), 0, LENGTHS[0])
        inner = F.filter(found, lambda p: (F.length(p["value"]) < F.length(c["value"])) & models.random(p["value"]))
        return F.transform(inner, lambda p: F.struct((c["start"] + p["start"]).alias("start"), (c["start"] + p["end"]).alias("end"), p["value"].alias("value")))

    whole = lambda c: F.array(c).cast(SPANS)
    hits = F.flatten(F.transform("candidates", lambda c: F.when(models.random(c["value"]), whole(c)).otherwise(parts(c).cast(SPANS))))
    return _of_kind(hits, KINDS.index("markov"))


def _told(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans.

    Texts are read once; what was found is staged, models are trained on it, and the
    candidates they take for random join the base findings. Null and empty texts have
    no spans. Repeated rows are told alike; other columns are ignored; an empty table
    gives an empty result.
    """
    scanned = staged(scan(docs), "secrets")
    models = train(scanned)
    rows = scanned.withColumn("random", _random(models))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in LEAST] + [F.size("random").cast("long").alias("n_markov")]
    return rows.select("doc_id", *counts, F.sha2(_told(F.col("base")), 256).alias("base_sha256"), _told(F.array_sort(F.concat("base", "random"))).alias("spans"))


def _masked(text: Column, spans: Column, mask: str) -> Column:
    """``text`` with ``mask`` for each group of overlapping spans, which are sorted.

    Texts are cut into chunks first: finding a place in a long text means reading it
    from its start.
    """

    def between(t: Column, start: Column, end: Column) -> Column:
        first, last = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
        chunk = lambda i: F.coalesce(F.get(t["chunks"], i), F.lit(""))
        inside = F.substring(chunk(first), start % CHUNK + 1, end - start)
        across = F.concat(
            F.substring(chunk(first), start % CHUNK + 1, F.lit(CHUNK)),
            F.array_join(F.slice(t["chunks"], first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
            F.substring(chunk(last), F.lit(1), end % CHUNK),
        )
        return F.when(end <= start, F.lit("")).when(first == last, inside).otherwise(across)

    def built(t: Column) -> Column:
        before = lambda i: F.coalesce(F.get(t["reach"], i - 1), F.lit(0))
        shown = F.transform(t["spans"], lambda s, i: F.when((s["start"] >= before(i)) | (i == 0), F.concat(between(t, before(i), s["start"]), F.lit(mask))).otherwise(F.lit("")))
        return F.concat(F.array_join(shown, ""), between(t, F.element_at(t["reach"], -1), t["length"]))

    reach = running(F.transform(spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x), F.lit(0))
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return let(F.struct(chunks.alias("chunks"), reach.alias("reach"), spans.alias("spans"), F.length(text).alias("length")), built)


def mask_secrets(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """The rows of ``docs`` with every span of its text replaced by ``mask``; overlapping
    spans make one. n_chars follows the text where the table has it.

    Null and empty texts stay as they are. Time grows with a text and its spans, however
    long. Repeated rows are masked alike, other columns stay, whatever their names; an
    empty table gives an empty result.
    """
    models = train(staged(scan(docs), "secrets"))
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")
    rows = scan(docs, row).withColumn("_spans", F.array_sort(F.concat("base", _random(models))))
    text = F.col("_row.text")
    clean = F.when(F.size("_spans") == 0, text).otherwise(_masked(text, F.col("_spans"), mask))
    rows = rows.select("_row", clean.alias("_clean"))
    own = {"text": F.col("_clean"), "n_chars": F.length("_clean").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return rows.select(*[(own[c] if c in own else F.col("_row")[c]).alias(c) for c in docs.columns])
