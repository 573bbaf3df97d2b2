"""Scalar text functions as Column expressions; all are null-safe in that null counts as the empty text unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom import config as C


def _s(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def strip(col: Column | str) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(_s(col), r"(?U)^\s+|\s+$", "")


def spaced(col: Column | str) -> Column:
    """White space of any kind collapsed to single spaces, none at the ends."""
    return strip(F.regexp_replace(_s(col), r"(?U)\s+", " "))


def folded(col: Column | str) -> Column:
    """``spaced``, lower case."""
    return F.lower(spaced(col))


def matched(col: Column | str) -> Column:
    """``folded`` with full-width parentheses as ASCII ones."""
    return F.translate(folded(col), "（）", "()")


def sentences(col: Column | str) -> Column:
    """Array of sentences: each of 。！？.!? ends one and stays with it; stripped; a rest without mark is kept; empty ones go."""
    pieces = F.regexp_extract_all(_s(col), F.lit("[^。！？.!?]*[。！？.!?]|[^。！？.!?]+$"), F.lit(0))
    return F.filter(F.transform(pieces, strip), lambda s: s != "")


def page_text(col: Column | str) -> Column:
    """Form feeds and other white space collapsed."""
    return spaced(F.regexp_replace(_s(col), "\f", " "))


def _unmarked(m: Column) -> Column:
    return F.btrim(F.regexp_replace(_s(m), r"(?U)\s+", ""), F.lit(C.OUTER_MARKS))


def _unled(m: Column) -> Column:
    return F.when((F.length(m) > 3) & F.substring(m, 1, 1).isin("和", "的"), F.substr(m, F.lit(2))).otherwise(m)


def _closed(m: Column) -> Column:
    closed = m.endswith(")") | m.endswith("）")
    return F.when(m.startswith("刑法修正案(") & ~closed, F.concat(m, F.lit(")"))).when(m.startswith("刑法修正案（") & ~closed, F.concat(m, F.lit("）"))).otherwise(m)


def clean_mention(col: Column | str) -> Column:
    """No white space, no marks around, no leading conjunction, an open amendment bracket closed."""
    return _closed(_unled(_unmarked(F.col(col) if isinstance(col, str) else col)))


def clean_mentions(items: Column) -> Column:
    """``clean_mention`` of each of an array: a step at a time, as nothing is shared within a lambda."""
    return reduce(F.transform, (_unmarked, _unled, _closed), items)


def numeric(col: Column | str) -> Column:
    """Only Chinese, Arabic or full-width digits, at least one."""
    return _s(col).rlike(f"^[{C.NUMERALS}]+$")


def bad_mention(col: Column | str, kind: Column | None = None, rules: str = "full", limits: C.Config = C.CONFIG, letters: str = C.LETTERS) -> Column:
    """Whether a mention is noise. rules: full; truth (without the book rules); legacy (lengths, digits and book rules alone). ``letters``: one of them makes a name."""
    m = _s(col)
    bad = (F.length(m) < limits.mention_min) | (F.length(m) > limits.mention_max) | numeric(m)
    if rules != "legacy":
        ends = reduce(lambda a, b: a | b, (m.endswith(x) for x in C.GENERIC_ENDS))
        bad = bad | ~m.rlike(f"[{letters}]") | m.isin(*C.STOP_WORDS) | (ends & (F.length(m) <= limits.generic_max))
    if rules != "truth" and kind is not None:
        book = (F.length(m) < 3) | (F.substring(m, 1, 1).isin("的", "和") & (F.length(m) <= 4)) | m.isin(*C.BOOK_STOPS)
        bad = bad | ((F.lower(_s(kind)) == "book") & book)
    return bad


def split_list(col: Column | str, rules: str = "full", limits: C.Config = C.CONFIG, letters: str = C.LETTERS) -> Column:
    """A listing as its distinct cleaned parts, in order; itself where no part is left. truth: parts pass ``bad_mention``, nothing is exempt."""
    m = _s(col)
    parts = F.transform(F.split(m, f"[{C.LIST_MARKS}]"), clean_mention)
    parts = F.filter(parts, (lambda p: ~bad_mention(p, rules="truth", limits=limits, letters=letters)) if rules == "truth" else (lambda p: F.length(p) >= limits.mention_min))
    parts = F.array_distinct(parts)
    whole = ~m.rlike(f"[{C.LIST_MARKS}]")
    if rules != "truth":
        whole = whole | m.isin(*C.UNSPLIT)
    return F.when(m == "", F.expr("cast(array() as array<string>)")).when(whole | (F.size(parts) == 0), F.array(m)).otherwise(parts)


def span(text: Column | str, mention: Column | str) -> Column:
    """struct<start,end> of the first occurrence, null if there is none."""
    at = F.position(_s(mention), _s(text)) - 1
    return F.when(at >= 0, F.struct(at.alias("start"), (at + F.length(_s(mention))).alias("end")))


def confidence(col: Column | str, default: float = C.CONFIG.relation_confidence) -> Column:
    """A number clamped to 0..1; the default where it can't be read."""
    c = F.col(col) if isinstance(col, str) else col
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c.cast("string").try_cast("double"), F.lit(default))))


def relation(col: Column | str, truth: bool = False) -> Column:
    """An allowed relation; others become related_to, or null for truth."""
    r = strip(col)
    return F.when(r.isin(*(C.TRUTH_RELATIONS if truth else C.BASE_RELATIONS)), r).otherwise(F.lit(None).cast("string") if truth else F.lit("related_to"))


def kg_fact(col: Column | str) -> Column:
    """struct<src,rel,dst> of ``a|r|b`` (further parts ignored) or ``a --r--> b``; null otherwise."""
    s = strip(col)
    bars = F.transform(F.split(s, r"\|"), strip)
    left, right = F.regexp_extract(s, r"(?s)^(.*?)--", 1), F.regexp_extract(s, r"(?s)^.*?--(.*)$", 1)
    rel, dst = strip(F.regexp_extract(right, r"(?s)^(.*?)-->", 1)), strip(F.regexp_extract(right, r"(?s)^.*?-->(.*)$", 1))
    src = strip(left)
    as_fact = lambda a, r, b: F.struct(a.alias("src"), r.alias("rel"), b.alias("dst"))
    return F.when(F.size(bars) >= 3, as_fact(F.get(bars, F.lit(0)), F.get(bars, F.lit(1)), F.get(bars, F.lit(2)))).when((src != "") & (rel != "") & (dst != ""), as_fact(src, rel, dst))


def answer(col: Column | str) -> Column:
    """The letter A-D of an answer; the answer in upper case where there is none."""
    a = F.upper(strip(col))
    found = F.regexp_extract(a, r"(?U)\b([ABCD])\b", 1)
    return F.when(a.isin("A", "B", "C", "D"), a).when(found != "", found).otherwise(a)


def json_object(col: Column | str) -> Column:
    """From the first { to the last } of a reply; null if there is none."""
    return F.nullif(F.regexp_extract(_s(col), r"(?s)\{.*\}", 0), F.lit(""))


def json_fallbacks(col: Column | str) -> Column:
    """A reply's JSON object: the reply itself, a fenced block, or the span of braces, whichever parses first; null if none does."""
    t = strip(col)
    whole = lambda x: F.when(F.try_parse_json(x).isNotNull() & x.startswith("{"), x)
    return F.coalesce(whole(t), whole(strip(F.regexp_extract(t, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1))), whole(F.coalesce(json_object(t), F.lit(""))))


def json_array(col: Column | str) -> Column:
    """From the first [ to the last ] of a reply without its fences; null if there is none."""
    return F.nullif(F.regexp_extract(F.regexp_replace(strip(col), r"^```(?:json)?\s*|\s*```$", ""), r"(?s)\[.*\]", 0), F.lit(""))


def percent(col: Column | str, key: str, default: int = C.CONFIG.judge_default) -> Column:
    """A whole score 0..100 of a JSON reply; the default where it can't be read."""
    value = F.get_json_object(json_object(col), f"$.{key}").try_cast("double").cast("int")
    return F.least(F.lit(100), F.greatest(F.lit(0), F.coalesce(value, F.lit(default))))


def rubric(col: Column | str, key: str, default: int = 3) -> Column:
    """A score 1..5 of a JSON reply, else the first digit within 50 characters after the key, else the default."""
    text = F.lower(_s(col))
    value = F.coalesce(F.get_json_object(json_object(col), f"$.{key}").try_cast("int"), F.nullif(F.regexp_extract(text, f"(?s){key}.{{0,50}}?(\\d)", 1), F.lit("")).try_cast("int"), F.lit(default))
    return F.least(F.lit(5), F.greatest(F.lit(1), value))


def coverage_score(entities: Column, relations: Column, best: int = 3) -> Column:
    """Half for 100 less 20 for each entity off ``best`` (0 for none), half for a relation."""
    ent = F.when(entities <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), 100.0 - 20.0 * F.abs(entities - best)))
    return 0.5 * ent + 0.5 * F.when(relations >= 1, 100.0).otherwise(0.0)


def fact_text(src: Column, rel: Column, dst: Column, context: Column | None = None) -> Column:
    """A fact as shown to a question writer, with its sentence if it has one."""
    fact = F.concat(F.lit("事实："), src, F.lit(" --"), rel, F.lit("--> "), dst)
    return fact if context is None else F.when(_s(context) != "", F.concat(fact, F.lit("\n来源原句："), context)).otherwise(fact)


def backfilled(new: Column, old: Column) -> Column:
    """The new text unless it is blank."""
    return F.coalesce(F.nullif(strip(new), F.lit("")), old)


def aliases(col: Column | str) -> Column:
    """Aliases by the first separator that occurs, of | , ， ； ;"""
    a = strip(col)
    cut = F.when(a == "", F.expr("cast(array() as array<string>)"))
    for mark in ("|", ",", "，", "；", ";"):
        cut = cut.when(a.contains(mark), F.split(a, rf"\{mark}" if mark == "|" else mark))
    return F.filter(F.transform(cut.otherwise(F.array(a)), spaced), lambda x: x != "")


def numbered(prefix: str, n: Column, width: int = 5) -> Column:
    """An identifier such as n00042; longer numbers are kept whole."""
    return F.format_string(f"{prefix}%0{width}d", n)


def key_parts(col: Column | str, unknown: str = "UNK_LABEL") -> Column:
    """struct<name,label> of a node key ``name||label``, cut at the first mark; a key without one is a name with the label ``unknown``."""
    parts = F.split(_s(col), r"\|\|", 2)
    return F.struct(F.get(parts, F.lit(0)).alias("name"), F.coalesce(F.get(parts, F.lit(1)), F.lit(unknown)).alias("label"))


def wrapped(col: Column | str, width: int = 8, lines: int = 2) -> Column:
    """A label on at most two lines of ``width`` characters, cut with an ellipsis."""
    s = _s(col)
    rows = [F.substr(s, F.lit(1 + i * width), F.lit(width)) for i in range(lines)]
    text = reduce(lambda a, b: F.when(b != "", F.concat(a, F.lit("\n"), b)).otherwise(a), rows)
    return F.when(F.length(s) > width * lines, F.concat(text, F.lit("…"))).otherwise(text)


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall and F1; 0 where a denominator is 0."""
    p, r = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)), F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    return {"precision": p, "recall": r, "f1": F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))}
