"""Secret scans [native]: patterns, and character Markov models of random strings and of identifiers."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed patterns of the base kinds, in their listed order.
PATTERNS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{24,}",
}
KINDS = [*PATTERNS, "random"]
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Runs of this length or more are held against the two models.
LEAST = 20
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST},}}"
#: Log-likelihood ratio, for each character, from which a run counts as random.
MARGIN = 0.35
#: Sum of the ratios above MARGIN from which a stretch inside a run counts as random.
STRETCH = 12
SPAN = "struct<start:int,ord:int,stop:int>"


def _places(text: str, pattern: str, kind: str, keep: str) -> str:
    """SQL: spans of a pattern's leftmost non-overlapping matches for which ``keep`` (of m, g and i) holds.

    The pieces between the matches give the places: Spark has no function for
    the places of all matches.
    """
    group = 2 if kind == "assign" else 0
    m, g, p = f"regexp_extract_all({text}, r'{pattern}', 0)", f"regexp_extract_all({text}, r'{pattern}', {group})", f"split({text}, r'{pattern}')"
    return (
        f"aggregate(sequence(0, size({m}) - 1), "
        f"named_struct('m', {m}, 'g', {g}, 'p', {p}, 'at', 0, 'out', cast(array() as array<{SPAN}>)), "
        f"(a, i) -> named_struct('m', a.m, 'g', a.g, 'p', a.p, 'at', a.at + length(a.p[i]) + length(a.m[i]), 'out', "
        f"if({keep}, concat(a.out, array(named_struct('start', a.at + length(a.p[i]), 'ord', {KINDS.index(kind)}, 'stop', a.at + length(a.p[i]) + length(a.m[i])))), a.out)), "
        f"a -> a.out)"
    )


def _quoted(pattern: str) -> str:
    return pattern.replace("'", r"\x27")


def base_spans(text: str = "text") -> Column:
    """Spans of the base kinds, by start, then kind. Texts without a match run each pattern once."""
    keeps = {"assign": "length(a.g[i]) >= 6", "access": "length(a.m[i]) >= 20", "hex": "length(a.m[i]) >= 24"}
    arms = [
        f"if({text} rlike r'{_quoted(p)}', {_places(text, _quoted(p), kind, keeps[kind])}, cast(array() as array<{SPAN}>))"
        for kind, p in PATTERNS.items()
    ]
    return F.expr(f"array_sort(concat({', '.join(arms)}))")


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratios of a pair of characters: random strings against identifiers."""

    ratios: list[float]


def labelled_samples(spark: SparkSession, each: int = 4000) -> DataFrame:
    """(label, value): ``each`` random strings and as many identifiers, made by a rule.

    Random strings are cuts of base-64, upper-case base-64 and hexadecimal
    digests of a running number. Identifiers join two to four common words of
    program and prose text in camel, snake, kebab, path and plain style, some
    with a number at the end; runs of one character count with them.
    """
    words = "get set add new old max min sum all any key map row col file path name user data list item node tree text line word page size time date code test main init load save read write open close start stop begin error value index table query count order group price total number string buffer stream socket server client request response handler manager factory builder parser reader writer message account address customer product service session context config option default result status update delete insert select internal external information international development representation implementation the and with that from this have which their there would about other into more some than then these only over also after first where most through between under again".split()
    ids = spark.range(each)
    digest = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(digest("a"))), r"\s", "")
    take = lambda c: F.substr(c, F.lit(1), (F.lit(LEAST) + F.pmod(F.col("id"), F.lit(21))).cast("int"))
    randoms = ids.select(F.lit(1).alias("label"), take(F.when(F.col("id") % 4 == 0, digest("b")).when(F.col("id") % 4 == 1, F.upper(b64)).otherwise(b64)).alias("value"))
    listed = F.array(*[F.lit(w) for w in words])
    pick = lambda k: F.get(listed, F.pmod(F.xxhash64(F.lit(k), F.col("id")), F.lit(len(words))).cast("int"))
    parts = F.slice(F.array(*[pick(k) for k in range(6)]), 1, (F.pmod(F.col("id"), F.lit(4)) + 3).cast("int"))
    style = F.pmod(F.xxhash64(F.lit("style"), F.col("id")), F.lit(6))
    name = (
        F.when(style == 0, F.array_join(F.transform(parts, F.initcap), ""))
        .when(style == 1, F.array_join(parts, "_"))
        .when(style == 2, F.array_join(parts, "-"))
        .when(style == 3, F.array_join(parts, "/"))
        .when(style == 4, F.concat(F.upper(F.array_join(parts, "_")), F.pmod(F.col("id"), F.lit(100)).cast("string")))
        .otherwise(F.array_join(parts, ""))
    )
    runs = spark.range(4 * len(ALPHABET)).select(F.lit(0), F.repeat(F.substr(F.lit(ALPHABET), (F.col("id") % len(ALPHABET) + 1).cast("int"), F.lit(1)), F.lit(24)))
    return randoms.union(ids.select(F.lit(0).alias("label"), name.alias("value"))).union(runs)


def train(samples: DataFrame) -> Model:
    """Count character pairs by label in Spark; at most two counts for each pair of the alphabet come to the driver."""
    n = len(ALPHABET)
    clean = F.regexp_replace("value", "[^A-Za-z0-9+/_=-]", "")
    pairs = samples.select("label", clean.alias("v")).where("length(v) > 1").select("label", F.explode(F.transform(F.sequence(F.lit(1), F.length("v") - 1), lambda i: F.struct(F.expr("v").alias("v"), i.alias("i")))).alias("x"))
    pairs = pairs.select("label", (F.expr(f"instr('{ALPHABET}', substr(x.v, x.i, 1))") - 1).alias("a"), (F.expr(f"instr('{ALPHABET}', substr(x.v, x.i + 1, 1))") - 1).alias("b"))
    counts = {(r["label"], r["a"], r["b"]): r["n"] for r in pairs.groupBy("label", "a", "b").agg(F.count("*").alias("n")).collect()}
    smooth = 0.5
    ratios = []
    for a in range(n):
        sums = [sum(counts.get((k, a, b), 0) for b in range(n)) + smooth * n for k in (0, 1)]
        ratios += [math.log((counts.get((1, a, b), 0) + smooth) / sums[1]) - math.log((counts.get((0, a, b), 0) + smooth) / sums[0]) for b in range(n)]
    return Model(ratios)


def _let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` for ``value``, which is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def scores_sql(value: str, model: Model) -> str:
    """SQL: the log-likelihood ratio of each pair of neighbours in ``value``."""
    table = ",".join(f"{x:.6g}" for x in model.ratios)
    pair = f"cast(split('{table}', ',') as array<double>)[codes[i - 1] * {len(ALPHABET)} + codes[i]]"
    codes = f"transform(split({value}, ''), c -> instr('{ALPHABET}', c) - 1)"
    return _let(codes, "codes", f"transform(sequence(1, size(codes) - 1), i -> {pair})")


def _span(start: str, stop: str) -> str:
    return f"named_struct('start', cast({start} as int), 'ord', {KINDS.index('random')}, 'stop', cast({stop} as int))"


def stretches_sql(scores: str, at: str) -> str:
    """SQL: spans of the best stretches of LEAST characters or more in a run that starts at ``at``, by the sum of their ratios above MARGIN.

    One pass: ``best`` is the greatest sum of a stretch that ends at character i
    (either the window of LEAST characters or the best one before, longer by
    one). A stretch ends at its top once the sum falls STRETCH below it; the
    next one starts behind it.
    """
    k = LEAST - 1
    none = "-1e9D"
    begin = f"named_struct('window', 0D, 'best', {none}, 'from', 0, 'top', {STRETCH}D, 'start', 0, 'stop', 0, 'floor', 0, 'out', cast(array() as array<{SPAN}>))"
    window = f"a.window + {scores}[i - 1] - {MARGIN}D - if(i > {k}, {scores}[greatest(i - {k} - 1, 0)] - {MARGIN}D, 0D)"
    longer = f"a.best + {scores}[i - 1] - {MARGIN}D"
    fresh = f"i - {k} >= a.floor and w >= {longer}"
    step = (
        f"if(a.top > {STRETCH}D and n.best < a.top - {STRETCH}D, "
        f"named_struct('window', w, 'best', {none}, 'from', 0, 'top', {STRETCH}D, 'start', 0, 'stop', 0, 'floor', a.stop, 'out', concat(a.out, array({_span(f'{at} + a.start', f'{at} + a.stop')}))), "
        f"named_struct('window', w, 'best', n.best, 'from', n.from, 'top', greatest(a.top, n.best), "
        f"'start', if(n.best > a.top, if(a.top > {STRETCH}D, least(a.start, n.from), n.from), a.start), 'stop', if(n.best > a.top, i + 1, a.stop), 'floor', a.floor, 'out', a.out))"
    )
    best = f"if({fresh}, named_struct('best', w, 'from', i - {k}), named_struct('best', {longer}, 'from', a.from))"
    return (
        f"aggregate(sequence(1, size({scores})), {begin}, (a, i) -> {_let(window, 'w', _let(best, 'n', step))}, "
        f"a -> if(a.top > {STRETCH}D, concat(a.out, array({_span(f'{at} + a.start', f'{at} + a.stop')})), a.out))"
    )


def _random_spans(model: Model) -> str:
    """SQL: random spans in the runs, outside the base spans.

    What base spans leave of a run is judged whole by its mean ratio; where that
    is too low, the parts that the best stretches of the run cover count.
    """
    pieces = (
        "aggregate(filter(base, b -> b.start < x.stop and x.start < b.stop), "
        f"named_struct('at', x.start, 'out', cast(array() as array<{SPAN}>)), "
        f"(a, b) -> named_struct('at', greatest(a.at, b.stop), 'out', if(b.start > a.at, concat(a.out, array({_span('a.at', 'b.start')})), a.out)), "
        f"a -> if(a.at < x.stop, concat(a.out, array({_span('a.at', 'x.stop')})), a.out))"
    )
    total = "aggregate(slice(scores, p.start - x.start + 1, p.stop - p.start - 1), 0D, (s, r) -> s + r)"
    whole = f"p.stop - p.start >= {LEAST} and {total} > {MARGIN}D * (p.stop - p.start - 1)"
    parts = f"filter(transform(best, y -> {_span('greatest(y.start, p.start)', 'least(y.stop, p.stop)')}), y -> y.start < y.stop)"
    judged = f"flatten(transform({pieces}, p -> if({whole}, array(p), {parts})))"
    scores = scores_sql("substr(__text, x.start + 1, x.stop - x.start)", model)
    return f"flatten(transform(__runs, x -> {_let(scores, 'scores', _let(stretches_sql('scores', 'x.start'), 'best', judged))}))"


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with two columns more: ``base`` and ``found``, arrays of (start, ord, stop) in code points, stop exclusive.

    ``found`` has the base spans and, besides, what the Markov models call
    random in runs of 20 characters or more: a whole run, or stretches inside
    it; base spans are cut out of both. Null and empty texts have none, an empty
    table gives no rows, and repeated rows are read one by one. Long texts are
    read whole. All rows and columns stay, but columns named ``base``, ``found``,
    ``__text`` or ``__runs`` give way (``redact`` keeps them).
    """
    model = train(labelled_samples(docs.sparkSession)) if model is None else model
    docs = docs.drop("base", "found", "__text", "__runs")
    df = docs.withColumn("__text", F.coalesce(F.col("text"), F.lit(""))).withColumn("base", base_spans("__text"))
    runs = f"if(__text rlike r'{CANDIDATE}', {_places('__text', CANDIDATE, 'random', 'true')}, cast(array() as array<{SPAN}>))"
    df = df.withColumn("__runs", F.expr(runs))
    return df.withColumn("found", F.expr(f"array_sort(concat(base, {_random_spans(model)}))")).drop("__text", "__runs")


def joined(spans: str) -> Column:
    """``kind:start:stop`` of the spans, by comma."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat({names}[x.ord], ':', x.start, ':', x.stop)), ',')")


def secrets(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans) for each row of ``docs``."""
    found = scan(docs.select("doc_id", "text"), model)
    count = lambda k: F.expr(f"cast(size(filter(found, x -> x.ord = {k})) as long)")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), count(3).alias("n_random"), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("found").alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", model: Model | None = None) -> DataFrame:
    """``docs`` with every span found in ``text`` replaced by ``mark``; overlapping spans become one.

    Null texts stay null, and all other columns stay as they are, whatever their
    names. An empty table gives no rows; repeated rows stay.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    df = scan(docs.select("text", rest), model)
    merged = (
        "aggregate(found, named_struct('at', 0, 'out', cast(array() as array<string>)), (a, x) -> named_struct("
        "'at', greatest(a.at, x.stop), 'out', if(x.start >= a.at, "
        f"concat(a.out, array(substr(text, a.at + 1, x.start - a.at), '{mark}')), a.out)), "
        "a -> concat(array_join(a.out, ''), substr(text, a.at + 1)))"
    )
    shown = F.expr(f"if(text is null or size(found) = 0, text, {merged})")
    return df.select(*[shown.alias(c) if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
