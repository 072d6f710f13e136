"""Text values that lost their end.

Per source and field the histograms of lengths, in characters and in bytes, are
tested for spikes: lengths at which a feed's values, or those of them without a
final mark, pile up, because a limit lies there. Of the two units the one counts
at whose spikes more unfinished values lie; a mark of omission takes the room of three characters in both. Values at a spike that end without
terminal punctuation are flagged (``by`` = spike). Two kinds can stand there by
chance, and the histogram decides about them too: values of a field that may go
without a final mark, stopping at a known ending, are flagged only where they
pile up themselves; values with a mark of omission after a known ending only
where most marks of that form follow an unfinished sentence, i.e. where the feed
cuts and marks.

Cuts in mid-transfer lie at no spike. Away from the spikes a second signal
decides (``by`` = ending): white space, closing quotes, bracketed remarks and
rating marks are set aside; a sentence mark then makes a value whole. What ends
in a mark of omission or in a bare word is held against the field itself: its
last two words (capitalised words as one class) must be known from before a
sentence mark elsewhere. Whether a field may go without a final mark is read off
the share of its values that do so after a known ending.

Patterns run on the ends of values only where plain string operations don't
decide; sentence ends are found by splitting. Only lengths, flags, ids and word
pairs are shuffled, all but the ids summed before; the joins spread hot word
pairs and hot sources by salting.

Defined cases: null, empty and blank values are no cases; a value with an
opening quote or bracket that is not closed is cut unless a sentence mark ends
it; a repeated (id, field) is reported once; a null source is a source; null
ids are reported as null; other columns are ignored; values are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcweave.runtime import join_bounded, union_all, write_stage

#: Endings seen before a sentence mark fewer times than this, or in a smaller share of a field's sentences, are unknown.
MIN_SEEN, MIN_SHARE = 3, 1e-5
#: Share of finished values without a mark from which a field may lack one.
BARE_STYLE = 0.2
#: A length is a spike above mean + SPIKE_SIGMA * sqrt(mean) + SPIKE_LEAST of its neighbours.
SPIKE_SIGMA, SPIKE_LEAST, SPIKE_REACH = 6.0, 5.0, 5

_BLANK = r"\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200D}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_BLANKS = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200E), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
_QUOTES, _STARS = "”\"’'»›」』", "★☆⭐✩✭✮✯✰*"
#: what may follow a finished sentence
_AFTER = rf"(?:[{_BLANK}]++|[{_QUOTES}]++|[{_STARS}]++|[(\[][^()\[\]]*+[)\]])*+\z"
_OMISSION = rf"(?:…|\.{{3,}}+|[(\[][{_BLANK}]*+(?:…|\.{{3,}}+)[{_BLANK}]*+[)\]])[{_BLANK}{_QUOTES}]*+\z"
_MARKS = (".", "!", "?", "。", "！", "？")
_OPEN = r"(?:“[^”]*+|\([^)]*+|\[[^\]]*+)\z"
_LAST_TWO = rf"(?<![^{_BLANK}])([^{_BLANK}]++[{_BLANK}]++[^{_BLANK}]++)\z"


def _pair(x: Column) -> Column:
    """Two words as a class: no marks, capitalised words as one, single blanks."""
    bare = F.regexp_replace(x, rf"[^\p{{L}}\p{{N}}{_BLANK}]", "")
    named = F.regexp_replace(bare, r"(?<![\p{L}\p{N}])\p{Lu}[\p{L}\p{N}]*+", "<N>")
    return F.regexp_replace(named, rf"[{_BLANK}]++", " ")


def _last_two(x: Column) -> Column:
    """The last two words, looked for near the end first."""
    near = F.regexp_extract(F.substring_index(x, " ", -4), _LAST_TWO, 1)
    return F.when(near != "", near).otherwise(F.regexp_extract(x, _LAST_TWO, 1))


def _long(df: DataFrame, key: str, fields: list[str], source: str) -> DataFrame:
    parts = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"`{f}`").cast("string").alias("v")) for f in fields])
    rows = df.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("\0")).alias("source"), F.explode(parts).alias("x"))
    return rows.select("id", "source", "x.field_name", "x.v").filter(F.rtrim("v", F.lit(_BLANKS)) != "")


def sentence_ends(values: DataFrame) -> DataFrame:
    """``field_name, pair, seen``: the pairs of words before a single sentence
    mark that a blank, a closing quote or bracket or the end follows."""
    parts = F.split(F.translate(F.concat("v", F.lit(" ")), "!?", ".."), r"\.")  # the blank stands for the end
    n = F.size("parts") - 1
    each = values.select("field_name", parts.alias("parts")).filter(n > 0)
    before = F.concat(F.array(F.lit("")), F.slice("parts", F.lit(1), n - 1))
    each = each.select("field_name", F.explode(F.arrays_zip(before.alias("before"), F.slice("parts", F.lit(1), n).alias("now"), F.slice("parts", F.lit(2), n).alias("next"))).alias("x"))
    last, first = F.right("x.now", F.lit(1)), F.left("x.next", F.lit(1))
    ok = each.filter(~last.isin("", "…", *_BLANKS) & first.isin(*_BLANKS, *_QUOTES, ")", "]"))
    ok = ok.select("field_name", F.substring_index(F.concat("x.before", F.lit(". "), "x.now"), " ", -3).alias("end"))
    # the patterns are run once per distinct end
    seen = ok.groupBy("field_name", "end").count()
    seen = seen.select("field_name", _pair(F.regexp_extract("end", _LAST_TWO, 1)).alias("pair"), "count").filter("pair <> ''")
    return seen.groupBy("field_name", "pair").agg(F.sum("count").alias("seen"))


def _endings(values: DataFrame) -> DataFrame:
    """Each value with ``omitted``, ``core`` (what stands before all that may
    follow a sentence), ``kind`` and ``form`` (of its mark of omission)."""
    v, core, bare = F.col("v"), F.col("core"), F.col("bare")
    # a step at a time, so that no pattern is run twice on a value
    step = values.withColumn("bare", F.rtrim("v", F.lit(_BLANKS + _QUOTES + _STARS)))
    remark = bare.endswith(")") | bare.endswith("]")
    step = step.withColumn("base", F.when(~remark, bare).when(v.rlike(_OMISSION), v).otherwise(F.regexp_replace(v, _AFTER, "")))
    step = step.withColumn("omitted", F.when(remark, F.col("base").rlike(_OMISSION)).otherwise(bare.endswith("…") | bare.endswith("...")))
    step = step.withColumn("core", F.when(F.col("omitted"), F.regexp_replace(F.regexp_replace("base", _OMISSION, ""), _AFTER, "")).otherwise(F.col("base")))
    step = step.withColumn("final", F.right(core, F.lit(1)))
    opens = (v.contains("“") | v.contains("(") | v.contains("[")) & v.rlike(_OPEN)
    step = step.withColumn("kind", (
        F.when(F.col("final").isin(*_MARKS), "finished").when((core == "") & ~F.col("omitted"), "finished")
        .when(opens | ~F.col("final").rlike(r"[\p{L}\p{N}\p{M}]"), "open")
        .when(F.col("omitted"), "omitted").otherwise("bare")
    ))
    return step.withColumn("form", F.when(F.col("omitted"), F.when(F.rtrim("base", F.lit(_BLANKS + _QUOTES + ")]")).endswith("…"), "…").otherwise("...")))


def judge(df: DataFrame, key: str, fields: list[str], source: str) -> DataFrame:
    """One row per row and non-blank field: ``id, source, field_name, kind,
    cut, by``; a null source is given as U+0000. ``by``: spike or ending, of cut values."""
    values = _long(df, key, fields, source)
    seen = write_stage(sentence_ends(values), "endings")
    total = seen.groupBy("field_name").agg(F.sum("seen").alias("total"))
    known = seen.join(F.broadcast(total), "field_name").filter((F.col("seen") >= MIN_SEEN) & (F.col("seen") >= MIN_SHARE * F.col("total")))  # a row per field
    known = known.select("field_name", "pair", F.lit(True).alias("known"))
    unsure = F.col("kind").isin("omitted", "bare")
    marked = _endings(values).select("id", "source", "field_name", (F.length("v") + F.when(F.col("form") == "…", 2).otherwise(0)).alias("chars"), F.octet_length("v").alias("bytes"), "kind", "omitted", "form", F.when(unsure, _pair(_last_two(F.col("core")))).alias("pair"))
    marked = write_stage(marked, "values")
    judged = join_bounded(marked.filter(unsure), known, ["field_name", "pair"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    flat = write_stage(judged.unionByName(marked.filter(~unsure).withColumn("known", F.lit(False))), "judged")
    style = {r["field_name"]: (r["b"] or 0) / max(1, (r["b"] or 0) + (r["f"] or 0)) >= BARE_STYLE for r in flat.groupBy("field_name").agg(F.sum(F.expr("int(kind = 'bare' and known)")).alias("b"), F.sum(F.expr("int(kind = 'finished')")).alias("f")).collect()}
    may_be_bare = F.col("field_name").isin(*[f for f, ok in style.items() if ok]) if any(style.values()) else F.lit(False)
    at = write_stage(spikes(flat), "spikes")
    for unit in ("chars", "bytes"):
        one = at.filter(F.col("unit") == unit).select("source", "field_name", F.col("length").alias(unit), *[F.col(c).alias(f"{c}_{unit}") for c in ("piled", "dots", "ellipsis")])
        flat = join_bounded(flat, one, ["source", "field_name", unit], "left")
    either = lambda c: F.coalesce(f"{c}_chars", F.lit(False)) | F.coalesce(f"{c}_bytes", F.lit(False))
    at_spike = F.col("piled_chars").isNotNull() | F.col("piled_bytes").isNotNull()
    whole_bare = F.col("known") & may_be_bare
    by_spike = F.when(F.col("kind") == "bare", ~whole_bare | either("piled")).when(F.col("kind") == "omitted", ~F.col("known") | F.when(F.col("form") == "…", either("ellipsis")).otherwise(either("dots"))).otherwise(F.col("kind") == "open")
    by_ending = F.when(F.col("kind") == "bare", ~whole_bare).when(F.col("kind") == "omitted", ~F.col("known")).otherwise(F.col("kind") == "open")
    by = F.when(at_spike & by_spike, "spike").when(~at_spike & by_ending, "ending")
    return flat.select("id", "source", "field_name", "kind", by.isNotNull().alias("cut"), by.alias("by"))


def spikes(flat: DataFrame) -> DataFrame:
    """The lengths, in the unit of its limit, at which a source's field has far
    more values, or far more without a final mark, than at the lengths around:
    ``source, field_name, unit, length``, and whether bare values with a known
    ending are ``piled`` up there too, and whether most marks of omission of the
    form ``dots`` or ``ellipsis`` follow an unfinished sentence there."""
    count = lambda e: F.sum(F.expr(f"int({e})"))
    cols = {"n": F.count("*"), "n_finished": count("kind = 'finished'"), "n_unfinished": count("kind = 'open' or kind in ('bare', 'omitted') and not known"), "n_bare": count("kind = 'bare' and known")}
    for name, form in (("dots", "..."), ("ellipsis", "…")):
        cols[f"{name}_all"] = count(f"form = '{form}' and kind in ('open', 'omitted')")
        cols[f"{name}_cut"] = count(f"form = '{form}' and (kind = 'open' or kind = 'omitted' and not known)")
    hist = union_all([flat.groupBy("source", "field_name", F.lit(u).alias("unit"), F.col(u).alias("length")).agg(*[x.alias(c) for c, x in cols.items()]) for u in ("chars", "bytes")])
    w = Window.partitionBy("source", "field_name", "unit").orderBy("length").rangeBetween(-SPIKE_REACH, SPIKE_REACH)
    above = lambda c, usual: F.col(c) > usual + SPIKE_SIGMA * F.sqrt(usual) + SPIKE_LEAST
    field, unit = Window.partitionBy("source", "field_name"), Window.partitionBy("source", "field_name", "unit")
    # whole values without a mark are as long as the ones with it, but for the mark
    like = F.greatest(F.col("n_finished"), F.sum("n_finished").over(unit.orderBy("length").rangeBetween(1, 1))) * F.sum("n_bare").over(unit) / F.greatest(F.sum("n_finished").over(unit), F.lit(1))
    for c in ("n", "n_unfinished", "n_bare"):
        around = (F.sum(c).over(w) - F.col(c)) / (2 * SPIKE_REACH)
        hist = hist.withColumn(f"{c}_usual", F.greatest(around, like) if c == "n_bare" else around)
    found = hist.filter((above("n", F.col("n_usual")) | above("n_unfinished", F.col("n_unfinished_usual"))) & (F.col("n_unfinished") > 0))
    found = found.withColumn("mine", F.sum("n_unfinished").over(unit)).withColumn("most", F.max("mine").over(field)).filter("mine = most")
    piled = above("n_bare", F.col("n_bare_usual")) & (F.col("n_bare") > 2 * F.col("n_bare_usual"))
    form = lambda c: (F.col(f"{c}_all") > 0) & (2 * F.col(f"{c}_cut") >= F.col(f"{c}_all"))
    return found.select("source", "field_name", "unit", "length", piled.alias("piled"), form("dots").alias("dots"), form("ellipsis").alias("ellipsis"))


def truncated(df: DataFrame, key: str = "id", fields: tuple[str, ...] = ("summary", "tagline"), source: str = "source") -> DataFrame:
    """``id, field_name`` of the cut values, each once."""
    return judge(df, key, list(fields), source).filter("cut").select("id", "field_name").distinct()


def share_by_source(df: DataFrame, key: str = "id", fields: tuple[str, ...] = ("summary", "tagline"), source: str = "source") -> DataFrame:
    """``source, n_values, n_cut, n_spike, n_ending, share``: how often each
    source cuts, at its limits and elsewhere; a value delivered twice counts once."""
    once = judge(df, key, list(fields), source).groupBy("source", "id", "field_name").agg(F.max("by").alias("by"))
    count = lambda e: F.sum(F.expr(f"int({e})"))
    out = once.groupBy("source").agg(F.count("*").alias("n_values"), count("by is not null").alias("n_cut"), F.count(F.when(F.col("by") == "spike", 1)).alias("n_spike"), F.count(F.when(F.col("by") == "ending", 1)).alias("n_ending"))
    return out.select(F.when(F.col("source") != "\0", F.col("source")).alias("source"), "n_values", "n_cut", "n_spike", "n_ending", (F.col("n_cut") / F.col("n_values")).alias("share"))
