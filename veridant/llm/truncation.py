"""Texts cut off by field limits or in transfer.

Lengths: for each source the discrete hazard of a length (texts that
end there among those that reach it) is tested against the hazards of neighbouring lengths,
at single lengths and in blocks, with the false discovery rate held under `alpha` per source. Endings:
the last line of each text is classed as closed, open or unclear; which list items and titles are
whole, and which numbers end sentences, is learnt as shares of distinct texts of the whole corpus. A text is cut
if it ends incomplete, that is open or unclear, at a significant length. Transfers also cut at lengths that no limit
explains: away from significant lengths an open ending counts if its shape is one of cuts, that is if
significant lengths hold it at a higher rate than other lengths do, by bounds of both rates.

Scale: every text is read once and reduced to a narrow row (lengths, class, hashes of what it holds), which is
written to the checkpoint folder; all counts, windows and joins see those rows only. Windows run over the distinct
lengths of a source, which its longest text bounds. Only Catalyst expressions touch the texts.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridant.session import cut_lineage

#: Widths of the blocks of lengths that are tested; 1 for limits met exactly, 8 for cuts back to a word.
BLOCKS = (1, 8)
#: Blocks on each side whose hazard is the comparison, leaving out the nearest one.
NEIGHBOURS = 12
#: Normal quantile of all bounds of rates and counts.
Z = 1.645
#: Share of the distinct texts with a list item or title that hold it as a whole line before others, or end with it
#: away from significant lengths, from which it closes texts; Wilson's lower bound decides.
CLOSING_SHARE = 0.5
#: A single line of up to this many characters without a sentence end is a headline.
HEADLINE = 130


def length_hazards(lengths: DataFrame, source: str, length: str, alpha: float = 0.01) -> DataFrame:
    """(source, block, width, ends, at_risk, expected, p_value, significant) of each block of lengths.

    The p value bounds the upper Poisson tail of `ends` at an upper bound of the neighbours' hazard (Chernoff);
    Benjamini-Hochberg decides within each source and width. Null sources form one group,
    null lengths are left out.
    """
    counts = lengths.filter(F.col(length).isNotNull()).groupBy(F.coalesce(source, F.lit("")).alias("source"), F.col(length).cast("bigint").alias("length")).agg(F.count("*").alias("n"))
    widths = F.explode(F.array(*[F.lit(w) for w in BLOCKS])).alias("width")
    b = counts.select("source", "n", "length", widths).groupBy("source", "width", F.floor(F.col("length") / F.col("width")).alias("block")).agg(F.sum("n").alias("ends"))
    at = Window.partitionBy("source", "width").orderBy("block")
    b = b.withColumn("at_risk", F.sum("ends").over(at.rowsBetween(0, Window.unboundedFollowing)))
    below, above = F.coalesce(F.sum("ends").over(at.rangeBetween(-NEIGHBOURS, -2)), F.lit(0)), F.coalesce(F.sum("ends").over(at.rangeBetween(2, NEIGHBOURS)), F.lit(0))
    b = b.withColumns({"below": below, "above": above})
    # blocks without an end are at risk too: all that exist below, and those above with the texts that get there
    exposed = F.greatest(F.least(F.col("block"), F.lit(NEIGHBOURS)) - 1, F.lit(0)) * F.col("at_risk") + (NEIGHBOURS - 1) * F.greatest(F.col("at_risk") - F.col("ends"), F.lit(1))
    # an upper bound of the neighbours' ends, so that few ends near a length prove nothing about it
    near = F.col("below") + F.col("above")
    hazard = (near + 0.5 + Z * F.sqrt(near + 0.25)) / exposed
    b = b.withColumn("expected", F.greatest(F.least(hazard, F.lit(1.0)) * F.col("at_risk"), F.lit(0.05)))
    excess = F.col("ends") * F.log(F.col("ends") / F.col("expected")) - F.col("ends") + F.col("expected")
    b = b.withColumn("p_value", F.when(F.col("ends") > F.col("expected"), F.exp(-excess)).otherwise(1.0))
    ranked = Window.partitionBy("source", "width").orderBy("p_value", "block")
    whole = Window.partitionBy("source", "width")
    b = b.withColumns({"rank": F.row_number().over(ranked), "tests": F.count("*").over(whole)})
    passed = F.when(F.col("p_value") <= alpha * F.col("rank") / F.col("tests"), F.col("rank"))
    b = b.withColumn("significant", F.coalesce(F.col("rank") <= F.max(passed).over(whole), F.lit(False)))
    return b.select("source", "block", "width", "ends", "at_risk", "expected", "p_value", "significant")


# Marks that a transfer leaves at a cut.
MARK = r"(\[\s*(\.\.\.|…)\s*\]|\(\s*(\.\.\.|…|more|continued)\s*\)|\[(truncated|cut|more)\]|…|\.\.\.)$"
# Lines with which documents end.
CLOSING = r"^(page \d+( of \d+)?|end of .+|source: .+|contact: .+|[*#=_ -]{3,}|.*• \p{L}+ \d{4})$"
#: A number before the last full stop that names something rather than measures.
LABEL_NUMBER = r"(?i)(fiscal|item|items|note|notes|page|section|part|year|ejercicio|exercice|jahr|geschäftsjahr|january|february|march|april|may|june|july|august|september|october|november|december)\s+\d+\.$"


#: A word and a number before a full stop, at the end of what is looked at.
NUMBER_END = r"(?<!\S)(\S{1,40}\s\S{0,40}\d)$"
#: The same before a full stop inside a text. It begins with the full stop, so that nothing is looked at elsewhere.
NUMBER_INSIDE = r"\.(?<=\d\.)(?<=(?<!\S)(\S{1,40}\s\S{0,40}\d)\.)"
#: Share of its places inside texts in which a number with a full stop ends a sentence: from the first on it closes
#: a text, up to the second it is a cut decimal. Bounds of Wilson's interval at Z decide, so that few places decide little.
SENTENCE_SHARE, DECIMAL_SHARE = 0.5, 0.1
#: What may follow the end of a text without meaning anything.
BLANKS = " \t\r\n\f\u000b\u00a0\u2028\u2029"


#: Characters at the end of a text that the patterns of endings look at; each of them is shorter.
TAIL = 400


#: List items and signatures that are whole lines before others, after the line end before them.
LINES = {"list": r"\n((?:[-*•]|\d+[.)]) [^\n]*)(?=\n)", "signature": r"\n((?:/s/|—|–|--) ?\S[^\n]*,[^\n]*)(?=\n)"}
#: Values that an open shape counts for before anything is seen: cut texts at significant lengths, and elsewhere, of PRIOR_TEXTS each.
PRIOR_AT_LIMIT, PRIOR_ELSEWHERE, PRIOR_TEXTS = 9.0, 1.0, 10.0


def _ending(t: str, tail: str, last: str, prior: str) -> Column:
    """closed, open, unclear, list or signature, from the trimmed text, its tail, its last line and the one before."""
    T, E, L, P = F.col(t), F.col(tail), F.col(last), F.col(prior)
    bars = lambda c: F.length(c) - F.length(F.regexp_replace(c, r"\|", ""))
    whole_row = L.endswith("|") & ((bars(L) == bars(P)) | (~P.startswith("|") & (bars(L) >= 3)))
    return (
        F.when(T == "", "none")
        .when(E.rlike(MARK), "open")
        .when(L.startswith("|"), F.when(whole_row, "closed").otherwise("open"))
        .when(E.rlike(r"""[.!?…]["”»'’)\]]+$"""), "closed")
        .when(E.rlike(r"[0-9]\.$"), F.when(E.rlike(LABEL_NUMBER), "closed").otherwise("unclear"))
        .when(E.rlike(r"[.!?。！？]$"), "closed")
        .when(E.rlike(r"""[.!?]["”]? \([\p{L} ]+\)$"""), "closed")
        .when(F.lower(L).rlike(CLOSING), F.when(F.length(L) <= TAIL, "closed").otherwise("unclear"))
        .when(L.rlike(r"^(/s/|—|–|--) ?\S"), F.when(L.contains(","), "signature").otherwise("closed"))
        .when(L.rlike(r"^([-*•]|\d+[.)]) "), "list")
        .when(~T.contains("\n") & (F.length(T) <= HEADLINE) & ~T.rlike(r"[.!?] "), "closed")
        .otherwise("open")
    )


def _share_bounds(hits: Column, misses: Column) -> tuple[Column, Column]:
    """Wilson's lower and upper bound of hits / (hits + misses); 0 and 1 without any."""
    n, zz = hits + misses, Z * Z
    middle, half = hits + zz / 2, Z * F.sqrt(F.when(n > 0, hits * misses / n).otherwise(0.0) + zz / 4)
    return (middle - half) / (n + zz), (middle + half) / (n + zz)


def _number_key(x: Column) -> Column:
    """Key of a number's pattern: its text with digits masked; null if x holds no number."""
    return F.when(x != "", F.xxhash64(F.regexp_replace(x, r"\d+", "#")))


def _form_key(x: Column) -> Column:
    """Key of the masked number alone, without the word before it."""
    return F.when(x != "", F.xxhash64(F.substring_index(F.regexp_replace(F.regexp_replace(x, r"\d+", "#"), r"\s", " "), " ", -1)))


def _inner_numbers(t: str) -> Column:
    """Distinct (number, form, decimal) inside a text: numbers with a full stop that goes on as a decimal or ends a sentence."""
    entry = lambda x, decimal: F.struct(_number_key(x).alias("number"), _form_key(x).alias("form"), F.lit(decimal).alias("decimal"))
    decimals = F.regexp_extract_all(t, F.lit(NUMBER_INSIDE + r"(?=\d)"), 1)
    sentences = F.regexp_extract_all(t, F.lit(NUMBER_INSIDE + r"""(?=\s+["“(]?\p{Lu})"""), 1)
    found = F.concat(F.transform(decimals, lambda x: entry(x, True)), F.transform(sentences, lambda x: entry(x, False)))
    return F.array_distinct(F.filter(found, lambda x: x.number.isNotNull()))


def _number_endings(narrow: DataFrame) -> DataFrame:
    """(__number, __as_number) of the masked number patterns at the ends of texts: closed, open or unclear.

    Inside distinct texts a pattern goes on as a decimal or ends a sentence; the share of the latter does not depend
    on the number of texts. What a pattern's own places leave open, those of its number after any word decide.
    """
    inside = narrow.select("__hash", F.inline("__inner")).distinct().groupBy("number", "form").agg(F.count_if(~F.col("decimal")).alias("body"), F.count_if("decimal").alias("decimals"))
    forms = inside.groupBy("form").agg(F.sum("body").alias("form_body"), F.sum("decimals").alias("form_decimals"))
    at_end = narrow.filter("__number IS NOT NULL").select(F.col("__number").alias("number"), F.col("__form").alias("form")).distinct()
    e = at_end.join(inside.drop("form"), "number", "left").join(forms, "form", "left").na.fill(0)
    low, high = _share_bounds(F.col("body"), F.col("decimals"))
    form_low, form_high = _share_bounds(F.col("form_body"), F.col("form_decimals"))
    cut = (high <= DECIMAL_SHARE) | ((low <= DECIMAL_SHARE) & (form_high <= DECIMAL_SHARE))
    return e.select(F.col("number").alias("__number"), F.when(low >= SENTENCE_SHARE, "closed").when(cut, "open").when((high >= SENTENCE_SHARE) & (form_low >= SENTENCE_SHARE), "closed").otherwise("unclear").alias("__as_number"))


def _part(kind: str, x: Column) -> Column:
    """Key of what recurs in a list item or signature: the item, or the title after the name."""
    return F.xxhash64(F.concat(F.lit(kind), F.trim(x if kind == "list" else F.substring_index(x, ",", -1))))


def _inner_parts(t: str) -> Column:
    """Distinct keys of the list items and signatures that are whole lines before others."""
    after_line_end = F.concat(F.lit("\n"), F.col(t))
    return F.array_distinct(F.concat(*[F.transform(F.regexp_extract_all(after_line_end, F.lit(rx), 1), partial(_part, k)) for k, rx in LINES.items()]))


def _closing_parts(narrow: DataFrame) -> DataFrame:
    """(__part, __whole) of the parts at the ends of texts: whether a part is whole, by its share of distinct texts.

    A part cut by a field limit ends texts at significant lengths only and is no whole line anywhere else; copies of
    a text count once.
    """
    inside = narrow.select(F.explode("__parts").alias("__part"), "__hash", F.lit(True).alias("inside"), F.lit(False).alias("limit"))
    ends = narrow.filter("__part IS NOT NULL").select("__part", "__hash", F.lit(False).alias("inside"), F.col("at_limit").alias("limit"))
    seen = inside.unionByName(ends).groupBy("__part", "__hash").agg(F.max("inside").alias("inside"), F.max("limit").alias("limit"))
    counts = seen.groupBy("__part").agg(F.count_if(F.col("inside") | ~F.col("limit")).alias("free"), F.count_if("limit").alias("limited"))
    return counts.select("__part", (_share_bounds(F.col("free"), F.col("limited"))[0] >= CLOSING_SHARE).alias("__whole"))


def _cut_shapes(judged: DataFrame) -> DataFrame:
    """(__shape, __of_cuts) of the shapes of open endings: whether significant lengths hold them at a higher rate than others.

    Rates are over distinct texts; bounds of both, with the prior values, decide. There are as many rows as shapes.
    """
    counted = judged.filter("ending != 'none'").groupBy("at_limit", "__hash").agg(F.max(F.when(F.col("ending") == "open", F.col("__shape"))).alias("__shape"))
    counts = counted.groupBy("at_limit", "__shape").agg(F.count("*").alias("n"))
    of = lambda flag: F.sum(F.when(F.col("at_limit") == flag, F.col("n")).otherwise(0))
    # a few rows: two for each shape
    everything = Window.partitionBy(F.lit(1))
    counts = counts.withColumns({"t1": of(True).over(everything), "t0": of(False).over(everything)})
    s = counts.filter("__shape IS NOT NULL").groupBy("__shape").agg(of(True).alias("n1"), of(False).alias("n0"), F.max("t1").alias("t1"), F.max("t0").alias("t0"))
    at_limit, elsewhere = F.col("n1") + PRIOR_AT_LIMIT, F.col("n0") + PRIOR_ELSEWHERE
    low = _share_bounds(at_limit, F.col("t1") + PRIOR_TEXTS - at_limit)[0]
    high = _share_bounds(elsewhere, F.col("t0") + PRIOR_TEXTS - elsewhere)[1]
    return s.select("__shape", (low > high).alias("__of_cuts"))


def _left_join(df: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """Left join in which rows with a null key, most of them here, are spread instead of meeting in one partition."""
    spread_key = F.coalesce(key, F.xxhash64(F.lit("\u0000"), "__hash", "__chars", "__bytes"))
    side = side.filter(F.col(key).isNotNull()).withColumnRenamed(key, "__side")
    return df.withColumn("__spread", spread_key).join(side, (F.col("__spread") == F.col("__side")) & F.col(key).isNotNull(), "left").drop("__spread", "__side")


def judge_endings(documents: DataFrame, keep: list[str], text: str, source: str, alpha: float = 0.01) -> DataFrame:
    """The columns `keep` of every row, with ending, at_limit, evidence and truncated.

    ending: none (null or empty text), closed, open or unclear; at_limit: the length, in characters or
    bytes, is significant for the source; evidence: length for an ending that is not closed at a significant length, ending
    for an open one of a shape that cuts have at another length, else null; truncated: there is evidence. A closing line
    of over TAIL characters is unclear. Every row comes out once, repeated ones as often as they come in; the added names
    must not be among `keep`. Null sources form one source.
    """
    d = documents.select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)], F.col(text).alias("__text"), F.col(source).alias("__src"))
    d = d.withColumn("__t", F.rtrim(F.coalesce("__text", F.lit("")), F.lit(BLANKS)))
    d = d.withColumn("__end", F.right("__t", F.lit(TAIL)))
    lines = F.split(F.substring_index("__t", "\n", -2), "\n")
    d = d.withColumns({"__last": F.element_at(lines, -1), "__prior": F.when(F.size(lines) > 1, F.element_at(lines, 1)).otherwise("")})
    d = d.withColumn("__class", _ending("__t", "__end", "__last", "__prior"))
    number = F.when(F.col("__class") == "unclear", F.regexp_extract(F.expr("rtrim('.', right(__t, 85))"), NUMBER_END, 1))
    last = F.col("__last")
    shape = F.when(F.col("__end").rlike(MARK), "mark").when(last.startswith("|"), "row").when(F.col("__end").rlike(r"\d$"), "number").when(F.col("__end").rlike(r"\p{L}$"), "word").otherwise("other")
    d = d.select(
        *[f"__k{i}" for i in range(len(keep))],
        F.coalesce("__src", F.lit("")).alias("__src"),
        F.length("__text").alias("__chars"),
        F.octet_length("__text").alias("__bytes"),
        F.xxhash64("__t").alias("__hash"),
        "__class",
        F.when(F.col("__class").isin("open", "unclear"), shape).alias("__shape"),
        F.when(F.col("__class") == "list", _part("list", last)).when(F.col("__class") == "signature", _part("signature", last)).alias("__part"),
        _number_key(number).alias("__number"),
        _form_key(number).alias("__form"),
        _inner_numbers("__t").alias("__inner"),
        _inner_parts("__t").alias("__parts"),
    )
    d = cut_lineage(d)
    both = F.explode(F.array(F.struct(F.lit("chars").alias("m"), F.col("__chars").alias("l")), F.struct(F.lit("bytes").alias("m"), F.col("__bytes").alias("l")))).alias("x")
    measured = d.select("__src", both).select(F.concat_ws("\u0001", "x.m", "__src").alias("key"), F.col("x.l").alias("l"))
    # one row for each source with the significant blocks of each measure and width
    hot = length_hazards(measured, "key", "l", alpha).filter("significant")
    kinds = [(m, w) for m in ("chars", "bytes") for w in BLOCKS]
    hot = hot.groupBy(F.substring_index("source", "\u0001", -1).alias("__src")).agg(*[F.collect_set(F.when(F.col("source").startswith(m + "\u0001") & (F.col("width") == w), F.col("block"))).alias(f"__{m}{w}") for m, w in kinds])
    d = d.join(hot, "__src", "left")
    limits = [F.coalesce(F.array_contains(f"__{m}{w}", F.floor(F.col(f"__{m}") / w)), F.lit(False)) for m, w in kinds]
    d = d.withColumn("at_limit", limits[0] | limits[1] | limits[2] | limits[3]).drop(*[f"__{m}{w}" for m, w in kinds])
    parts, numbers = _closing_parts(d), _number_endings(d)
    d = _left_join(d.drop("__inner", "__parts"), parts, "__part")
    # a number and a full stop end a sentence if they do so inside texts, and are a cut decimal if they go on there
    d = _left_join(d, numbers, "__number")
    ending = F.when(F.col("__part").isNotNull(), F.when(F.col("__whole"), "closed").otherwise("unclear")).when(F.col("__number").isNotNull(), F.coalesce("__as_number", F.lit("unclear"))).otherwise(F.col("__class"))
    d = d.withColumn("ending", ending)
    d = d.join(F.broadcast(_cut_shapes(d)), "__shape", "left")
    incomplete = F.col("ending").isin("open", "unclear")
    d = d.withColumn("evidence", F.when(incomplete & F.col("at_limit"), "length").when((F.col("ending") == "open") & F.col("__of_cuts"), "ending"))
    return d.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], "ending", "at_limit", "evidence", F.col("evidence").isNotNull().alias("truncated"))


def find_truncated(documents: DataFrame, text: str, source: str, alpha: float = 0.01) -> DataFrame:
    """`documents` with ending, at_limit, evidence and truncated, as by judge_endings; columns of the added names are replaced."""
    added = ("ending", "at_limit", "evidence", "truncated")
    return judge_endings(documents, [c for c in documents.columns if c not in added], text, source, alpha)


def truncation_rates(found: DataFrame, source: str) -> DataFrame:
    """How often each source truncates: texts, cut texts, share, and cuts at a field limit."""
    return found.filter("ending != 'none'").groupBy(source).agg(
        F.count("*").alias("texts"), F.count_if("truncated").alias("cut_texts"), F.avg(F.col("truncated").cast("double")).alias("cut_share"), F.count_if(F.col("evidence") == "length").alias("at_limit_texts")
    )
