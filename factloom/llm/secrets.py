"""Secret scan: format matches plus sliding-window entropy, in DataFrame functions only.

Format kinds are leftmost non-overlapping regular-expression matches. The entropy kind takes candidate strings (long
runs of key characters with a letter and a digit), gives each a character class, and slides a window over it: counts
by character are carried from window to window, one leaving and one entering, and with them the sum of c*log2(c)
in whole millionths, so the entropy of every window costs one update and the comparison is exact. A candidate's span runs from
its first to its last window that reaches the class's threshold, unless an allow-list entry covers it.

Offsets are code points, end exclusive. Null and empty texts have no spans; each of repeated rows has its own; an empty table gives an empty
result. All columns of the input, whatever their names, are kept beside the result; a column ``spans`` is replaced. The cost of a
text is in proportion to its length and spans, however long a candidate is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.shared import fresh

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
RUN = "A-Za-z0-9+/_=-"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
#: Bits a character by class of candidate; a window must reach its class's figure.
BITS = {"hex": 3.0, "alnum": 3.7, "base64": 3.9}
#: Candidates that match are never secrets: UUIDs, integrity digests, placeholders, numbered names.
ALLOW = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^sha(1|256|384|512)-|example|placeholder|changeme|your[_-]|x{6,}|0{8,}|^[A-Za-z]+[_-]?[0-9]{1,4}$"
KINDS = ("assign", "access", "hex", "entropy")


def _weight(c: int) -> int:
    return round(c * math.log2(c) * 1e6) if c > 1 else 0


def _limit(bits: float) -> int:
    """The largest sum of c*log2(c), in millionths, of a window whose entropy reaches ``bits``."""
    return math.floor((math.log2(WINDOW) - bits) * WINDOW * 1e6)


#: Values that a running sum or maximum takes at a time, so that its array is never copied as a whole.
_RUN = 128


def _once(columns: dict[str, str], body: str) -> str:
    """``body`` with each name of ``columns`` bound to the value of its column. A column named inside a lambda and nowhere else is computed anew
    by every call of it, as Spark puts its expression there; a bound one is computed once a row."""
    for name, column in columns.items():
        body = f"transform(array({column}), {name} -> {body})[0]"
    return body


def _running(values: str, step: str) -> str:
    """An array: for each of the ints ``values`` what ``step`` (of z and y) makes of 0 and those before it."""
    part = f"slice({values}, b * {_RUN} + 1, {_RUN})"
    grow = f"(z, y) -> named_struct('p', {step.replace('z', 'z.p')}, 'a', array_append(z.a, z.p)), z -> z.a"
    none = "cast(array() as array<int>)"
    sums = f"transform(sequence(0, greatest(0, (size({values}) - 1) div {_RUN})), b -> aggregate({part}, 0, (z, y) -> {step}))"
    heads = f"aggregate({sums}, named_struct('p', 0, 'a', {none}), {grow})"
    return f"flatten(transform({heads}, (h, b) -> aggregate({part}, named_struct('p', h, 'a', {none}), {grow})))"


def _spans(found: str, gaps: str, sizes: str, kind: str, values: str | None = None) -> str:
    """Spans (s, k, e) of the matches ``found`` between the pieces ``gaps``, ``sizes`` being what each takes with the piece before it; of those
    whose ``values`` have 12 characters or more."""
    spans = f"transform({_running('own_sizes', 'z + y')}, (p, i) -> named_struct('s', p + length(own_gaps[i]), 'k', {KINDS.index(kind)}, 'e', p + own_sizes[i]))"
    kept = f"filter({spans}, (x, i) -> length(own_values[i]) >= 12)" if values else spans
    bound = {"own_gaps": gaps, "own_sizes": sizes} | ({"own_values": values} if values else {})
    return f"if(size({found}) > 0, {_once(bound, kept)}, cast(array() as array<struct<s:int,k:int,e:int>>))"


def scan(docs: DataFrame, text: str = "text", allow_values: tuple[str, ...] = (), out: str = "spans") -> DataFrame:
    """``docs`` with ``out``: array<struct<s,k,e>> by start, then kind (index into KINDS)."""
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "entropy": f"(?<![{RUN}])[{RUN}]{{20,}}"}
    raw, value, base, end, ends, more = (fresh(docs, f"_secret_{x}") for x in ("text", "value", "base", "end", "ends", "more"))
    m, g, n, s = ([fresh(docs, f"_secret_{x}{i}") for i in range(4)] for x in "mgns")
    df = docs.withColumn(raw, F.coalesce(F.col(text), F.lit("")))
    df = df.withColumns({m[i]: F.regexp_extract_all(raw, F.lit(p), F.lit(0)) for i, p in enumerate(patterns.values())})
    df = df.withColumns({g[i]: F.when(F.size(m[i]) > 0, F.split(raw, p, -1)) for i, p in enumerate(patterns.values())} | {value: F.when(F.size(m[0]) > 0, F.regexp_extract_all(raw, F.lit(ASSIGN), F.lit(2)))})
    df = df.withColumns({n[i]: F.expr(f"transform({m[i]}, (x, i) -> length({g[i]}[i]) + length(x))") for i in range(4)})
    df = df.withColumns({s[i]: F.expr(_spans(m[i], g[i], n[i], kind, None if i else value)) for i, kind in enumerate(patterns)})
    df = df.withColumn(base, F.array_sort(F.concat(*s[:3]))).withColumn(end, F.transform(base, lambda x: x["e"]))
    df = df.withColumn(ends, F.when(F.size(m[3]) > 0, F.concat(F.expr(_running(end, "greatest(z, y)")), F.array(F.array_max(end)))))
    none = F.expr("cast(array() as array<struct<s:int,k:int,e:int>>)")
    df = df.withColumn(more, F.when(F.size(m[3]) > 0, F.expr(_entropy_sql(m[3], s[3], base, ends, allow_values))).otherwise(none))
    return df.withColumn(out, F.array_sort(F.concat(base, more))).drop(raw, value, base, end, ends, more, *m, *g, *n, *s)


def _entropy_sql(found: str, at: str, base: str, ends: str, allow_values: tuple[str, ...]) -> str:
    """The entropy spans of a row from its candidates and their spans, without those that touch a span of ``base``; ``ends`` has the largest end of
    the first i of these."""
    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    weights = f"array({','.join(f'{_weight(c)}L' for c in range(WINDOW + 2))})"
    allow = f"rlike(x.c, {quoted(ALLOW)})" + (f" or x.c in ({','.join(map(quoted, allow_values))})" if allow_values else "")
    limit = f"case when rlike(x.c, '^[0-9a-fA-F]+$') then {_limit(BITS['hex'])}L when rlike(x.c, '^[A-Za-z0-9]+$') then {_limit(BITS['alnum'])}L else {_limit(BITS['base64'])}L end"
    # the counts of all characters are held in longs, five bits each; t: the sum of their weights. Each step takes one character in and one out
    longs = range(-(-len(ALPHABET) // 12))
    count = lambda c: "(shiftright(case " + " ".join(f"when {c} < {12 * q + 12} then acc.n{q}" for q in longs) + f" end, 5 * ({c} % 12)) & 31)"
    moved = lambda q: f"acc.n{q} + if(m.j div 12 = {q}, shiftleft(1L, 5 * (m.j % 12)), 0L) - if(m.o div 12 = {q}, shiftleft(1L, 5 * (m.o % 12)), 0L)"
    change = f"if(m.o = m.j, 0L, x.w[cast({count('m.j')} + 1 as int)] - x.w[cast({count('m.j')} as int)] + if(m.o < 0, 0L, x.w[cast({count('m.o')} - 1 as int)] - x.w[cast({count('m.o')} as int)]))"
    step = f"""(acc, i) -> transform(array(named_struct('j', x.z[i], 'o', if(i < {WINDOW}, -12, x.z[greatest(0, i - {WINDOW})]))), m -> transform(array(acc.t + {change}),
      t -> named_struct({', '.join(f"'n{q}', {moved(q)}" for q in longs)}, 't', t, 'f', if(acc.f < 0 and i >= {WINDOW - 1} and t <= x.t, i - {WINDOW - 1}, acc.f), 'l', if(i >= {WINDOW - 1} and t <= x.t, i - {WINDOW - 1}, acc.l)))[0])[0]"""
    start = f"named_struct({', '.join(f"'n{q}', 0L" for q in longs)}, 't', 0L, 'f', -1, 'l', -1)"
    hot = f"aggregate(sequence(0, size(x.z) - 1), {start}, {step}, acc -> named_struct('f', acc.f, 'l', acc.l))"
    rows = f"filter(transform({found}, (c, i) -> named_struct('c', c, 's', own_at[i].s)), x -> rlike(x.c, '[0-9]') and rlike(x.c, '[A-Za-z]'))"
    told = f"transform(filter({rows}, x -> not ({allow})), x -> named_struct('z', transform(split(x.c, ''), h -> instr('{ALPHABET}', h) - 1), 's', x.s, 'w', {weights}, 't', {limit}))"
    spans = f"filter(transform(transform({told}, x -> named_struct('s', x.s, 'h', {hot})), x -> named_struct('s', cast(x.s + x.h.f as int), 'k', 3, 'e', cast(x.s + x.h.l + {WINDOW} as int), 'f', x.h.f)), x -> x.f >= 0)"
    # spans of the base that begin before x ends, by bisection
    before = "aggregate(sequence(0, 30), 0, (p, q) -> if(p + shiftleft(1, 30 - q) <= size(own_base) and own_base[least(p + shiftleft(1, 30 - q), size(own_base)) - 1].s < x.e, p + shiftleft(1, 30 - q), p))"
    clear = f"transform(filter({spans}, x -> size(own_base) = 0 or own_ends[{before}] <= x.s), x -> named_struct('s', x.s, 'k', x.k, 'e', x.e))"
    return _once({"own_at": at, "own_base": base, "own_ends": ends}, clear)


def joined(spans: str, kinds: int = len(KINDS)) -> Column:
    """kind:start:end of the spans whose kind is below ``kinds``, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.filter(spans, lambda x: x["k"] < kinds), lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``scan`` replaced by ``mark`` in the text; overlapping spans become one. Null stays null."""
    spans, chars, end, done = (fresh(docs, f"_secret_{x}") for x in ("spans", "chars", "end", "done"))
    found = scan(docs, text, out=spans)
    some = F.size(spans) > 0
    found = found.withColumns({chars: F.when(some, F.split(text, "")), end: F.transform(spans, lambda x: x["e"])}).withColumn(done, F.when(some, F.expr(_running(end, "greatest(z, y)"))))
    piece = f"if(x.s >= own_done[i], concat(array_join(slice(own_chars, own_done[i] + 1, x.s - own_done[i]), ''), '{mark}'), '')"
    pieces = F.expr(_once({"own_done": done, "own_chars": chars}, f"transform({spans}, (x, i) -> {piece})"))
    rest = F.expr(f"array_join(slice({chars}, array_max({end}) + 1, size({chars})), '')")
    return found.withColumn(text, F.when(some, F.concat(F.array_join(pieces, ""), rest)).otherwise(F.col(text))).drop(spans, chars, end, done)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: counts, digest of the format spans and all spans of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs)
    count = lambda k: F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined("spans", 3), 256).alias("base_sha256"), joined("spans").alias("spans"), count(3).alias("n_entropy"))
