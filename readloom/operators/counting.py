"""Read counting: filter cascade, geometry, overlap, assignment, tables.

Input is one row per fragment (``fragments_of``): fid, and r1, r2, structs of the two ends' fields or null.  A single-end read has r2
null and FLAG bit 0x1 unset.  Fragments pass once: status, sections and length are columns of the fragment's row; its sections, one
row a bin, meet the features in one outer join, against a broadcast where the features are few (checked), and one shuffle by fragment
brings what a fragment met together.  A fragment that a rule rejects goes through as one row that meets nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.dna import DUPLICATE, REVERSE, SECOND, SECONDARY, UNMAPPED, cigar_sections, has
from readloom.operators.intervals import BIN, BIN_FACTOR, overlap_join, union_length
from readloom.operators.shares import in_shares
from readloom.session import written

#: A whole count; fractions are whole parts of it, as in fixed-point arithmetic.
UNIT = 65536
#: Rows of the summary, in order (fixed values).
STATUSES = [
    "Assigned", "Unassigned_Unmapped", "Unassigned_Read_Type", "Unassigned_Singleton", "Unassigned_MappingQuality", "Unassigned_Chimera", "Unassigned_FragmentLength", "Unassigned_Duplicate",
    "Unassigned_MultiMapping", "Unassigned_Secondary", "Unassigned_NonSplit", "Unassigned_NoFeatures", "Unassigned_Overlapping_Length", "Unassigned_Ambiguity",
]
#: All statuses, numbered from 1 in plans.
ALL = [*STATUSES, "Unassigned_Split"]
#: Rows of features, one a bin, that may be broadcast.
BROADCAST_FEATURES = 500_000
#: Equal fragments that are made together.
EQUAL = 4096


def statuses(o: CountOptions) -> list[str]:
    """Rows of the summary under these options."""
    return [s if s != "Unassigned_NonSplit" or not o.non_split_only else "Unassigned_Split" for s in STATUSES]


@dataclass(frozen=True)
class CountOptions:
    gene_level: bool = True
    strand: int = 0  # 0 any, 1 same, 2 opposite
    allow_multi_overlap: bool = False
    largest_overlap: bool = False
    min_overlap: int = 1
    frac_overlap: float = 0.0
    frac_overlap_feature: float = 0.0
    non_overlap: int | None = None
    non_overlap_feature: int | None = None
    count_multi_mapping: bool = True
    fraction: bool = False
    primary_only: bool = False
    primary_ignores_multi: bool = True  # as documented; False: a multi-mapping primary read is still rejected
    ignore_dup: bool = False
    min_mapq: int = 0
    paired: bool = False
    both_ends: bool = False
    check_length: bool = False
    min_length: int = 50
    max_length: int = 600
    count_chimeric: bool = True
    split_only: bool = False
    non_split_only: bool = False
    mate_orientation: str = "fr"
    shift_type: str = "upstream"
    shift: int = 0
    extend_5: int = 0
    extend_3: int = 0
    reduce_to: int | None = None  # 5 or 3
    bin_width: int = BIN

    @property
    def needs_lengths(self) -> bool:
        return bool(self.frac_overlap > 0 or self.min_overlap > 1 or self.largest_overlap or self.frac_overlap_feature > 0 or self.non_overlap is not None or self.non_overlap_feature is not None)


FIELDS = ["flag", "chr", "pos", "mapq", "cigar", "tlen", "nh"]


def _one(alignments: DataFrame) -> Column:
    """A record's FIELDS, and chr_length if there is one: the contig's length, at which shifts and extensions end."""
    return F.struct(*FIELDS, F.col("chr_length") if "chr_length" in alignments.columns else F.lit(None).cast("int").alias("chr_length"))


def fragments_of(alignments: DataFrame, by: list[str], carry: tuple[str, ...] = (), single: bool = False) -> DataFrame:
    """Alignments with FIELDS -> fid, carry, r1, r2; ``by`` names what the records of a fragment share, carry some of it.

    Where several records of an end share all of it, the n-th of end 1 and the n-th of end 2, by their fields, make a fragment: equal pairs
    count each.  Equal records go through as one row with a count, and what they make is dealt out by EQUAL, so ``by`` may be the same in most rows.
    single: no two records of an end share ``by``."""
    second = has(F.col("flag"), SECOND)
    fid = F.concat_ws("\x1f", *[F.col(c).cast("string") for c in by])
    rows = alignments.select(fid.alias("fid"), *carry, second.alias("second"), _one(alignments).alias("one"))
    ends = [F.max(F.when(F.col("second") == no, F.col("one"))).alias(f"r{i}") for i, no in ((1, False), (2, True))]
    if single:
        return rows.groupBy("fid", *carry).agg(*ends)
    counted = written(rows.groupBy("fid", *carry, "second", "one").agg(F.count(F.lit(1)).alias("n")), "counted")
    key = Window.partitionBy("fid", *carry)
    upto = key.orderBy("second", "one").rowsBetween(Window.unboundedPreceding, 0)
    last = F.sum("n").over(upto) - F.when(F.col("second"), F.coalesce(F.sum(F.when(~F.col("second"), F.col("n"))).over(key), F.lit(0))).otherwise(0)
    # numbers up to last: those of the next record of either end that stops there or later
    cuts = counted.withColumn("last", last).groupBy("fid", *carry, "last").agg(*ends)
    down = key.orderBy(F.desc("last"))
    here = [F.last(r, ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0)).alias(r) for r in ("r1", "r2")]
    cuts = cuts.select("fid", *carry, (F.coalesce(F.lead("last").over(down), F.lit(0)) + 1).alias("first"), "last", *here)
    if counted.filter(F.col("n") > EQUAL).limit(1).count():
        block = F.explode(F.sequence("first", "last", F.lit(EQUAL).cast("long")))
        tasks = int(alignments.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as few small rows would go to one task otherwise
        cuts = cuts.withColumn("first", block).withColumn("last", F.least("last", F.col("first") + EQUAL - 1)).repartition(tasks, "fid", *carry, "first")
    each = cuts.withColumn("nth", F.explode(F.sequence("first", "last")))
    return each.select(F.when(F.col("nth") > 1, F.concat_ws("\x1f", "fid", "nth")).otherwise(F.col("fid")).alias("fid"), *carry, "r1", "r2")


def single_fragments(alignments: DataFrame, fid: str = "fid", carry: tuple[str, ...] = ()) -> DataFrame:
    """Single-end records, each a fragment; no shuffle."""
    one = _one(alignments)
    return alignments.select(F.col(fid).alias("fid"), *carry, one.alias("r1"), F.lit(None).cast(alignments.select(one.alias("x")).schema["x"].dataType).alias("r2"))


def status_of(o: CountOptions) -> Column:
    """The first rule that rejects a fragment, end 1 before end 2; null if none does."""
    r1, r2 = F.col("r1"), F.col("r2")
    there1, there2 = r1.isNotNull(), r2.isNotNull()
    mapped1 = there1 & ~has(r1["flag"], UNMAPPED)
    mapped2 = there2 & ~has(r2["flag"], UNMAPPED)
    both = mapped1 & mapped2
    same_chr = r1["chr"] == r2["chr"]
    same_strand = has(r1["flag"], REVERSE) == has(r2["flag"], REVERSE)
    split1, split2 = (r["cigar"].contains("N") for r in (r1, r2))
    span = F.abs(F.coalesce(r1["tlen"], r2["tlen"], F.lit(0)))

    def rules(there: Column, mapped: Column, r: Column) -> Column:
        c = F.when(there & ~mapped1 & ~mapped2, "Unassigned_Unmapped")
        if o.paired and o.both_ends:
            c = c.when(there & ~both, "Unassigned_Singleton")
        if o.min_mapq > 0:
            c = c.when(there & (F.greatest(F.coalesce(r1["mapq"], F.lit(0)), F.coalesce(r2["mapq"], F.lit(0))) < o.min_mapq), "Unassigned_MappingQuality")
        if o.paired and o.check_length:
            c = c.when(there & both & same_chr & ~same_strand & ((span < o.min_length) | (span > o.max_length)), "Unassigned_FragmentLength")
        if o.paired and not o.count_chimeric:
            c = c.when(there & both & (~same_chr | same_strand), "Unassigned_Chimera")
        if o.ignore_dup:
            dup = F.coalesce(has(r1["flag"], DUPLICATE), F.lit(False)) | F.coalesce(has(r2["flag"], DUPLICATE), F.lit(False))
            c = c.when(there & dup, "Unassigned_Duplicate")
        if not o.count_multi_mapping and not (o.primary_only and o.primary_ignores_multi):
            c = c.when(there & mapped & (r["nh"] > 1), "Unassigned_MultiMapping")
        if o.primary_only:
            second = F.coalesce(has(r1["flag"], SECONDARY), F.lit(False)) | F.coalesce(has(r2["flag"], SECONDARY), F.lit(False))
            c = c.when(there & mapped & second, "Unassigned_Secondary")
        if o.split_only:
            c = c.when(there & mapped & ~F.coalesce(split1, F.lit(False)) & ~F.coalesce(split2, F.lit(False)), "Unassigned_NonSplit")
        if o.non_split_only:
            c = c.when(there & mapped & ((mapped1 & split1) | (mapped2 & split2)), "Unassigned_Split")
        return c

    return F.coalesce(rules(there1, mapped1, r1), rules(there2, mapped2, r2))


def _moved(s: Column, plus: Column, pos: Column, most: Column, o: CountOptions) -> Column:
    """Sections after shift, extension and reduction, in this order.  A shift moves all sections alike and, like an extension, ends at
    base 1 and at the contig's length, where it is known."""
    first, last = lambda: F.get(s, F.lit(0)), lambda: F.get(s, F.size(s) - 1)
    room = lambda ext, end: F.when(end + ext > most, most - end).otherwise(ext)  # noqa: E731  # null where the length is unknown: no bound
    if o.shift:
        to_right = {"upstream": F.when(plus, -o.shift).otherwise(o.shift), "downstream": F.when(plus, o.shift).otherwise(-o.shift), "left": F.lit(-o.shift), "right": F.lit(o.shift)}[o.shift_type]
        by = F.when((to_right < 0) & (first()["start"] <= -to_right), 1 - first()["start"]).when(to_right > 0, room(to_right, last()["end"])).otherwise(to_right)
        s = F.transform(s, lambda x: x.withField("start", x["start"] + by).withField("end", x["end"] + by))
    if o.extend_5 or o.extend_3:
        left = F.least(F.when(plus, o.extend_5).otherwise(o.extend_3), pos - 1)
        right = room(F.when(plus, o.extend_3).otherwise(o.extend_5), last()["end"])
        n = F.size(s)
        s = F.transform(s, lambda x, i: x.withField("start", F.when(i == 0, x["start"] - left).otherwise(x["start"])).withField("end", F.when(i == n - 1, x["end"] + right).otherwise(x["end"])))
    if o.reduce_to:
        at_left = plus if o.reduce_to == 5 else ~plus
        base = F.when(at_left, first()["start"]).otherwise(last()["end"])
        s = F.transform(F.slice(s, 1, 1), lambda x: x.withField("start", base).withField("end", base))
    return s


def _ceil(x: Column) -> Column:
    """Up only if a thousandth or more is left over."""
    return F.when(x - F.floor(x) >= 0.001, F.floor(x) + 1).otherwise(F.floor(x))


def _union(ranges: Column) -> Column:
    """Bases of an array of (chr, a, b), each once."""
    def add(acc: Column, x: Column) -> Column:
        fresh = ~acc["chr"].eqNullSafe(x["chr"]) | (x["a"] > acc["to"])
        more = F.when(fresh, x["b"] - x["a"] + 1).otherwise(F.greatest(x["b"] - acc["to"], F.lit(0)))
        return F.struct(x["chr"].alias("chr"), F.when(fresh, x["b"]).otherwise(F.greatest(x["b"], acc["to"])).alias("to"), (acc["n"] + more).alias("n"))

    start = F.struct(F.lit(None).cast("string").alias("chr"), F.lit(0).alias("to"), F.lit(0).alias("n"))
    return F.aggregate(F.array_sort(ranges), start, add, lambda acc: acc["n"])


def _insertions(s: Column) -> Column:
    """array<(at, length)> of a read's insertions; at is the reference base after one."""
    near = F.when(F.size(s) > 1, F.sequence(F.lit(0), F.size(s) - 2)).otherwise(F.array().cast("array<int>"))
    found = F.transform(near, lambda i: F.struct(F.get(s, i + 1)["start"].alias("at"), (F.get(s, i + 1)["read_start"] - F.get(s, i)["read_start"] - F.get(s, i)["end"] + F.get(s, i)["start"] - 1).alias("length"), F.get(s, i)["after"].alias("kind")))
    return F.transform(F.filter(found, lambda x: x["kind"] == "I"), lambda x: F.struct(x["at"].alias("at"), x["length"].alias("length")))


def fragment_length(s1: Column, s2: Column, chr1: Column, chr2: Column) -> Column:
    """Bases of a fragment: reference bases that either end covers, each once, and insertions: those that one end alone could have,
    and those that both have where both cover the place, once."""
    ranges = lambda s, c: F.transform(s, lambda x: F.struct(c.alias("chr"), x["start"].alias("a"), x["end"].alias("b")))
    i1, i2, one_chr = _insertions(s1), _insertions(s2), chr1 == chr2

    def counted(mine: Column, other: Column, others: Column, both: bool) -> Column:
        there = lambda x: F.coalesce(one_chr, F.lit(False)) & F.exists(other, lambda y: (y["start"] <= x["at"]) & (y["end"] >= x["at"]))
        kept = F.filter(mine, lambda x: ~there(x) | (F.lit(both) & F.array_contains(others, x)))
        return F.aggregate(kept, F.lit(0), lambda n, x: n + x["length"])

    return _union(F.concat(ranges(s1, chr1), ranges(s2, chr2))) + counted(i1, s2, i2, True) + counted(i2, s1, i1, False)


def _keyed(features: DataFrame, o: CountOptions) -> tuple[DataFrame, DataFrame, dict]:
    """Features with kid, a number for the key that is counted; kid and key, each once; and how many rows and keys there are."""
    key = F.col("gene_id") if o.gene_level else F.col("feature_id").cast("string")
    f = features.select("chr", F.col("start").alias("f_start"), F.col("end").alias("f_end"), F.col("strand").alias("f_strand"), "feature_id", key.alias("key"))
    for seed in range(100):
        numbered = f.withColumn("kid", F.xxhash64(F.lit(seed), "key"))
        wide = F.col("f_end") - F.col("f_start") >= o.bin_width * BIN_FACTOR
        bins = F.floor(F.col("f_end") / o.bin_width) - F.floor(F.col("f_start") / o.bin_width) + 1
        size = numbered.agg(
            F.count_if(wide).alias("wide"), F.coalesce(F.sum(F.when(wide, F.floor(bins / BIN_FACTOR) + 2).otherwise(bins)), F.lit(0)).alias("rows"), F.count_distinct("key").alias("keys"), F.count_distinct("kid").alias("kids")
        ).first()
        if size["keys"] == size["kids"]:
            return numbered, numbered.select("kid", "key").distinct(), size.asDict()
    raise RuntimeError("keys can't be numbered")


def _sections(fragments: DataFrame, o: CountOptions, carry: tuple[str, ...]) -> DataFrame:
    """fid, carry, code (of the status, 0 if open), nh, frag_length, s: array of (end, chr, strand, start, stop)."""
    status = status_of(o)
    df = fragments.withColumn("code", F.when(status.isNull(), 0).otherwise(F.array_position(F.array(*map(F.lit, ALL)), status)).cast("int"))
    nh = F.greatest(F.coalesce(F.col("r1")["nh"], F.lit(1)), F.coalesce(F.col("r2")["nh"], F.lit(1)))
    df = df.withColumn("nh", nh)
    for no in (1, 2):
        r = F.col(f"r{no}")
        there = (F.col("code") == 0) & r.isNotNull() & ~has(r["flag"], UNMAPPED)
        reverse = has(r["flag"], REVERSE) if no == 1 or o.mate_orientation != "fr" else ~has(r["flag"], REVERSE)
        df = df.withColumn(f"raw{no}", F.when(there, cigar_sections(r["cigar"], r["pos"]))).withColumn(f"raw{no}", F.coalesce(f"raw{no}", F.array().cast(df.select(cigar_sections(F.lit("1M"), F.lit(1)).alias("x")).schema["x"].dataType)))
        df = df.withColumn(f"strand{no}", F.when(reverse, "-").otherwise("+")).withColumn(f"s{no}", _moved(F.col(f"raw{no}"), F.col(f"strand{no}") == "+", r["pos"], r["chr_length"], o))
    length = fragment_length(F.col("s1"), F.col("s2"), F.col("r1")["chr"], F.col("r2")["chr"]) if o.frac_overlap > 0 or o.non_overlap is not None else F.lit(0)
    # a section that ends before it begins, beyond its contig, is none
    rows = lambda no: F.transform(F.filter(f"s{no}", lambda x: x["end"] >= x["start"]), lambda x: F.struct(F.lit(no).alias("end"), F.col(f"r{no}")["chr"].alias("chr"), F.col(f"strand{no}").alias("strand"), x["start"].alias("start"), x["end"].alias("stop")))
    return df.select("fid", *carry, "code", "nh", length.alias("frag_length"), F.concat(rows(1), rows(2)).alias("s"))


def _met(sections: DataFrame, features: DataFrame, size: dict, o: CountOptions, carry: tuple[str, ...]) -> DataFrame:
    """A row for each section, bin and feature that meet there first, and rows without a feature for what meets none."""
    narrow, broad = o.bin_width, o.bin_width * BIN_FACTOR
    two = size["wide"] > 0
    bins = lambda a, b, w, odd: F.sequence(F.floor(F.col(a) / w) * 2 + odd, F.floor(F.col(b) / w) * 2 + odd, F.lit(2).cast("long"))  # noqa: E731  # even: narrow bins, odd: broad ones
    each = sections.select("fid", *carry, "code", "nh", "frag_length", F.explode_outer("s").alias("s")).select("fid", *carry, "code", "nh", "frag_length", "s.*")
    spread = bins("start", "stop", narrow, 0)
    each = each.withColumn("bin", F.explode_outer(F.concat(spread, bins("start", "stop", broad, 1)) if two else spread))
    wide = F.col("f_end") - F.col("f_start") >= broad
    of = F.when(wide, bins("f_start", "f_end", broad, 1)).otherwise(bins("f_start", "f_end", narrow, 0)) if two else bins("f_start", "f_end", narrow, 0)
    f = features.drop("key").withColumn("f_bin", F.explode(of)).withColumnRenamed("chr", "f_chr")
    if size["rows"] <= BROADCAST_FEATURES:
        f = F.broadcast(f)
    else:  # rows that meet nothing are dealt out too
        each = each.withColumn("bin", F.coalesce("bin", -1 - F.pmod(F.xxhash64("fid"), F.lit(1 << 20)))).withColumn("chr", F.coalesce("chr", F.lit("")))
        # a bin that a third of the rows lie in is dealt out, its features repeated
        each, f = in_shares(each, f.withColumnsRenamed({"f_chr": "chr", "f_bin": "bin"}), ["chr", "bin"], ["fid", "start"])
        f = f.withColumnsRenamed({"chr": "f_chr", "bin": "f_bin", "__part": "f_part"})
    width = F.when(F.col("bin") % 2 == 0, narrow).otherwise(broad) if two else F.lit(narrow)
    first = F.greatest(F.floor(F.col("start") / width), F.floor(F.col("f_start") / width)) == F.floor(F.col("bin") / 2)
    on = (F.col("chr") == F.col("f_chr")) & (F.col("bin") == F.col("f_bin")) & (F.col("f_start") <= F.col("stop")) & (F.col("f_end") >= F.col("start")) & first
    if o.strand:
        on = on & (F.col("strand") == F.col("f_strand") if o.strand == 1 else F.col("strand") != F.col("f_strand"))
    if "f_part" in f.columns:
        on = on & (F.col("__part") == F.col("f_part"))
    return each.join(f, on, "left").drop("f_chr", "f_bin", "bin", "f_strand", "strand", "__part", "f_part")


def assign(fragments: DataFrame, features: DataFrame, o: CountOptions = CountOptions(), carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per fragment: fid, carry (columns of fragments), status, targets (array of keys), units (what each target gets).

    Features are evaluated once beforehand, to count them."""
    f, keys, size = _keyed(features, o)
    met = _met(_sections(fragments, o, carry), f, size, o, carry)
    by = ["fid", *carry]
    broadcast = (lambda df: F.broadcast(df)) if size["keys"] <= BROADCAST_FEATURES else (lambda df: df)
    code = lambda s: F.lit(ALL.index(s) + 1)
    if not o.needs_lengths and not o.allow_multi_overlap:
        if o.paired:  # a key that both ends meet goes before those that one end meets
            per = met.repartition("fid").groupBy(*by, "kid").agg(F.max("code").alias("code"), F.max("nh").alias("nh"), (F.min("end") < F.max("end")).alias("both"))
            lo, hi = (F.coalesce(agg(F.when(F.col("both"), F.col("kid"))), agg("kid")) for agg in (F.min, F.max))
        else:
            per, lo, hi = met, F.min("kid"), F.max("kid")
        one = per.groupBy(*by).agg(F.max("code").alias("code"), F.max("nh").alias("nh"), lo.alias("lo"), hi.alias("hi"))
        status = F.when(F.col("code") > 0, F.col("code")).when(F.col("lo").isNull(), code("Unassigned_NoFeatures")).when(F.col("lo") == F.col("hi"), code("Assigned")).otherwise(code("Unassigned_Ambiguity"))
        one = one.withColumn("code", status).withColumn("kid", F.when(status == code("Assigned"), F.col("lo"))).join(broadcast(keys), "kid", "left")
        done = one.withColumn("targets", F.when(F.col("key").isNull(), F.array().cast("array<string>")).otherwise(F.array("key")))
    else:
        per = _scored(met.repartition("fid"), o, by)
        hit = F.when(F.col("passes"), F.struct("score", "kid"))
        one = per.groupBy(*by).agg(F.max("code").alias("code"), F.max("nh").alias("nh"), F.count("kid").alias("met"), F.collect_list(hit).alias("hits"))
        top = F.array_max("hits")["score"]
        wins = F.transform(F.filter("hits", lambda x: x["score"] == top) if not o.allow_multi_overlap or o.largest_overlap else F.col("hits"), lambda x: x["kid"])
        one = one.withColumn("kids", wins)
        n = F.size("kids")
        many = code("Assigned") if o.allow_multi_overlap else code("Unassigned_Ambiguity")
        status = F.when(F.col("code") > 0, F.col("code")).when(F.col("met") == 0, code("Unassigned_NoFeatures")).when(n == 0, code("Unassigned_Overlapping_Length")).when(n == 1, code("Assigned")).otherwise(many)
        one = one.withColumn("code", status).withColumn("kids", F.when(status == code("Assigned"), F.col("kids")))
        named = one.select(*by, "code", "nh", F.explode_outer("kids").alias("kid")).join(broadcast(keys), "kid", "left")
        done = named.groupBy(*by).agg(F.max("code").alias("code"), F.max("nh").alias("nh"), F.sort_array(F.collect_list("key")).alias("targets"))
    weight = F.expr(f"{UNIT} div nh") if o.fraction and not o.primary_only else F.lit(UNIT).cast("long")
    if o.fraction and o.allow_multi_overlap:
        weight = F.floor(weight / F.greatest(F.size("targets"), F.lit(1)))
    assigned = F.col("code") == code("Assigned")
    return done.select("fid", *carry, F.element_at(F.array(*map(F.lit, ALL)), F.col("code")).alias("status"), "targets", F.when(assigned, weight.cast("long")).otherwise(F.lit(0).cast("long")).alias("units"))


def _scored(met: DataFrame, o: CountOptions, by: list[str]) -> DataFrame:
    """by, kid, code, nh, score, passes; met is dealt out by fragment."""
    facts = [F.max("code").alias("code"), F.max("nh").alias("nh"), F.max("frag_length").alias("frag_length")]
    both = F.when((F.min("end") < F.max("end")) & F.lit(not o.allow_multi_overlap), 1).otherwise(0)
    if not o.needs_lengths:
        return met.groupBy(*by, "kid").agg(*facts, (1 + both).alias("score")).withColumn("passes", F.col("kid").isNotNull())
    shared = F.when(F.col("kid").isNotNull(), F.struct("chr", F.greatest("start", "f_start").alias("a"), F.least("stop", "f_end").alias("b")))
    if o.frac_overlap_feature > 0 or o.non_overlap_feature is not None:
        each = met.groupBy(*by, "kid", "feature_id", "f_start", "f_end").agg(*facts, F.collect_list(shared).alias("x"), F.min("end").alias("a"), F.max("end").alias("z"))
        span = F.col("f_end") - F.col("f_start") + 1
        need = _ceil(span * o.frac_overlap_feature)
        if o.non_overlap_feature is not None:
            need = F.greatest(need, span - o.non_overlap_feature)
        each = each.withColumn("kid", F.when(_union(F.col("x")) >= need, F.col("kid")))
        per = each.groupBy(*by, "kid").agg(F.max("code").alias("code"), F.max("nh").alias("nh"), F.max("frag_length").alias("frag_length"), F.flatten(F.collect_list("x")).alias("x"), F.when((F.min("a") < F.max("z")) & F.lit(not o.allow_multi_overlap), 1).otherwise(0).alias("both"))
    else:
        per = met.groupBy(*by, "kid").agg(*facts, F.collect_list(shared).alias("x"), both.alias("both"))
    need = F.lit(o.min_overlap)
    if o.frac_overlap > 0:
        need = F.greatest(need, _ceil(F.col("frag_length") * o.frac_overlap))
    if o.non_overlap is not None:
        need = F.greatest(need, F.col("frag_length") - o.non_overlap)
    per = per.withColumn("shared", _union(F.col("x")))
    score = 2 * F.col("shared") + F.col("both") if o.largest_overlap else 1 + F.col("both")
    return per.select(*by, "kid", "code", "nh", score.alias("score"), (F.col("kid").isNotNull() & (F.col("shared") >= need)).alias("passes"))


def count_table(assigned: DataFrame) -> DataFrame:
    """key, units and count of the keys that got any."""
    each = assigned.filter("status = 'Assigned'").select(F.explode("targets").alias("key"), "units")
    return each.groupBy("key").agg(F.sum("units").alias("units")).withColumn("count", F.col("units") / UNIT)


def summary_table(assigned: DataFrame) -> DataFrame:
    """status, n."""
    return assigned.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def gene_table(features: DataFrame, counts: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """gene_id, exon lists, length (union per chromosome and strand), extra columns of the features, whose values are listed exon by exon, or
    once where all are equal, and count, 0 where nothing came."""
    length = union_length(features, ["gene_id", "chr", "strand"], name="n").groupBy("gene_id").agg(F.sum("n").alias("length"))
    rows = F.sort_array(F.collect_list(F.struct("feature_id", "chr", "start", "end", "strand", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in extra))))
    exons = features.groupBy("gene_id").agg(rows.alias("x"))
    joined = lambda c: F.array_join(F.transform("x", lambda v: v[c].cast("string")), ";").alias(c)
    once = lambda c: F.when(F.size(F.array_distinct(F.transform("x", lambda v: v[c]))) == 1, F.get("x", F.lit(0))[c]).otherwise(joined(c)).alias(c)
    lists = exons.select("gene_id", *map(joined, ("chr", "start", "end", "strand")), *map(once, extra))
    return lists.join(length, "gene_id").join(counts.select(F.col("key").alias("gene_id"), "count"), "gene_id", "left").na.fill({"count": 0.0})


def feature_table(features: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per feature: its columns, length and count."""
    met = features.withColumn("key", F.col("feature_id").cast("string")).join(counts.select("key", "count"), "key", "left").na.fill({"count": 0.0})
    return met.select("feature_id", "gene_id", "chr", "start", "end", "strand", (F.col("end") - F.col("start") + 1).alias("length"), "count")


def wide(counts: DataFrame, library: str = "file") -> DataFrame:
    """A column per library."""
    return counts.groupBy("key").pivot(library).agg(F.first("count")).na.fill(0)


# Junctions: an independent branch from the raw fragments, whatever their status.


def junctions(fragments: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """fid, carry, chr, left (last base before), right (first base after): each of a fragment's junctions once."""
    each = fragments.select("fid", *carry, F.explode(F.array("r1", "r2")).alias("r")).filter(F.col("r").isNotNull() & ~has(F.col("r.flag"), UNMAPPED) & F.col("r.cigar").contains("N"))
    s = each.select("fid", *carry, F.col("r.chr").alias("chr"), cigar_sections(F.col("r.cigar"), F.col("r.pos")).alias("s"))
    pairs = F.filter(F.transform(F.sequence(F.lit(0), F.size("s") - 2), lambda i: F.struct(F.get("s", i).alias("a"), F.get("s", i + 1).alias("b"))), lambda p: p["a"]["after"] == "N")
    cut = s.filter(F.size("s") > 1).select("fid", *carry, "chr", F.explode(pairs).alias("p"))
    return cut.select("fid", *carry, "chr", F.col("p.a.end").alias("left"), F.col("p.b.start").alias("right")).distinct()


def junction_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("chr", "left", "right").agg(F.count(F.lit(1)).alias("support"))


def classify_junctions(counts: DataFrame, exons: DataFrame) -> DataFrame:
    """Adds gene_name, transcript_id, status, n_exons, distance.  exons: gene_id, transcript_id, chr, start, end.

    KNOWN: both edges are edges of exons of one transcript; NOVEL: a gene's body holds both sites; NOVEL_FUSION: each lies in some
    gene's body; NA otherwise.  Named are the known transcripts' genes, or of the others those of which most sites are known;
    distance is from the nearest known site before the left and after the right one, NA where there is none.  A gene carries its exons, so each
    site meets each gene once, and a junction's genes come together in one shuffle."""
    site = ["chr", "left", "right"]
    genes = exons.groupBy("chr", "gene_id").agg(F.min("start").alias("f_start"), F.max("end").alias("f_end"), F.collect_set(F.struct("start", "end", "transcript_id")).alias("exons"))
    at = F.explode(F.array(F.struct(F.lit(1).alias("no"), F.col("left").alias("x")), F.struct(F.lit(2).alias("no"), F.col("right").alias("x"))))
    ends = counts.select(*site, at.alias("p")).select(*site, "p.no", "p.x")
    edge = lambda e: F.when(F.col("no") == 1, F.col("x") - e["end"]).otherwise(e["start"] - F.col("x"))
    far = F.array_min(F.filter(F.transform("exons", edge), lambda d: d >= 0))
    known = F.transform(F.filter("exons", lambda e: edge(e) == 0), lambda e: e["transcript_id"])
    met = overlap_join(ends, genes, ["chr"], ("x", "x")).select(*site, "no", F.struct(F.col("gene_id").alias("gene"), far.alias("far"), known.alias("known")).alias("g"))
    each = met.groupBy(*site).agg(*(F.sort_array(F.collect_list(F.when(F.col("no") == no, F.col("g")))).alias(f"g{no}") for no in (1, 2)))
    each = each.withColumn("tx", F.sort_array(F.array_intersect(*(F.flatten(F.transform(f"g{no}", lambda g: g["known"])) for no in (1, 2)))))
    named = lambda gs: F.transform(gs, lambda g: g["gene"])
    far_in = lambda gs, gene: F.get(F.filter(gs, lambda g: g["gene"] == gene), F.lit(0))["far"]
    zero = lambda far: F.coalesce((far == 0).cast("int"), F.lit(0))
    each = each.withColumn("both", F.transform(F.array_intersect(named("g1"), named("g2")), lambda gene: F.struct(gene.alias("gene"), far_in("g1", gene).alias("a"), far_in("g2", gene).alias("b"))))
    best = F.coalesce(F.array_max(F.transform("both", lambda g: zero(g["a"]) + zero(g["b"]))), F.lit(0))
    each = each.withColumn("best", best).withColumns({f"hit{no}": F.exists(f"g{no}", lambda g: g["far"] == 0) for no in (1, 2)})
    each = each.withColumns({f"hit{no}": F.coalesce(f"hit{no}", F.lit(False)) for no in (1, 2)})
    is_known, spans, apart = F.size("tx") > 0, F.size("both") > 0, (F.size("g1") > 0) & (F.size("g2") > 0)
    sided = lambda no: F.transform(F.filter(f"g{no}", lambda g: ~F.col(f"hit{no}") | F.coalesce(g["far"] == 0, F.lit(False))), lambda g: F.struct(g["gene"].alias("gene"), (g["far"] if no == 1 else F.lit(None).cast("int")).alias("a"), (g["far"] if no == 2 else F.lit(None).cast("int")).alias("b")))
    chosen = F.when(spans, F.filter("both", lambda g: zero(g["a"]) + zero(g["b"]) == F.col("best"))).when(apart, F.sort_array(F.concat(sided(1), sided(2))))
    text = lambda d: F.coalesce(d.cast("string"), F.lit("NA"))
    tx_genes = F.array_sort(named(F.filter("g1", lambda g: F.arrays_overlap(g["known"], F.col("tx")))))
    each = each.withColumn("chosen", chosen).select(
        *site,
        F.when(is_known, F.array_join(tx_genes, ",")).otherwise(F.array_join(named("chosen"), ",")).alias("gene_name"),
        F.when(is_known, F.array_join("tx", ",")).when(spans, "").alias("transcript_id"),
        F.when(is_known, "KNOWN").when(spans, "NOVEL").when(apart, "NOVEL_FUSION").alias("status"),
        F.when(is_known, 2).when(spans, F.col("best")).when(apart, F.col("hit1").cast("int") + F.col("hit2").cast("int")).alias("n_exons"),
        F.when(is_known, "0/0").otherwise(F.array_join(F.transform("chosen", lambda g: F.concat(text(g["a"]), F.lit("/"), text(g["b"]))), ",")).alias("distance"),
    )
    out = counts.join(each, site, "left")
    return out.withColumns({c: F.coalesce(c, F.lit("NA")) for c in ("gene_name", "transcript_id", "status", "distance")}).withColumn("n_exons", F.coalesce("n_exons", F.lit(0)))


def junction_strand(counts: DataFrame, contigs: DataFrame, chunk: int = 65_536) -> DataFrame:
    """Adds strand by the intron's ends: GT..AG +, CT..AC -, else null.

    contigs: chr, start, seq, in chunks that begin every ``chunk`` bases and overlap by one base or more.  Each end meets one chunk."""
    c = contigs.select("chr", F.floor((F.col("start") - 1) / chunk).alias("__c"), F.col("start").alias("__s"), F.upper("seq").alias("__q"))

    def two(df: DataFrame, at: Column, name: str) -> DataFrame:
        met = df.withColumn("__at", at).withColumn("__c", F.floor((F.col("__at") - 1) / chunk)).join(c, ["chr", "__c"], "left")
        return met.withColumn(name, F.expr("substring(__q, CAST(__at - __s + 1 AS INT), 2)")).drop("__at", "__c", "__s", "__q")

    met = two(two(counts, F.col("left") + 1, "__donor"), F.col("right") - 2, "__acceptor")
    donor, acceptor = F.col("__donor"), F.col("__acceptor")
    return met.withColumn("strand", F.when((donor == "GT") & (acceptor == "AG"), "+").when((donor == "CT") & (acceptor == "AC"), "-")).select(*counts.columns, "strand")


#: The eleven columns of the junction table before those of the libraries, in order (fixed values).
JUNCTION_COLUMNS = ["GeneName", "TranscriptID", "Status", "nExons", "Dist.to.nearest.splicing.site", "Site1_chr", "Site1_location", "Site1_strand", "Site2_chr", "Site2_location", "Site2_strand"]


def junction_table(classified: DataFrame, per_library: DataFrame) -> DataFrame:
    """The eleven columns and one a library, in order of place.  classified: as classify_junctions gives it, with strand if the genome is
    known; per_library: library, chr, left, right, support."""
    site = ["chr", "left", "right"]
    wide_ = per_library.groupBy(*site).pivot("library").agg(F.first("support")).na.fill(0)
    strand = F.coalesce("strand", F.lit("NA")) if "strand" in classified.columns else F.lit("NA")
    given = [F.col("gene_name"), F.col("transcript_id"), F.col("status"), F.col("n_exons"), F.col("distance"), F.col("chr"), F.col("left"), strand, F.col("chr"), F.col("right"), strand]
    named = classified.select(*site, *(c.alias(n) for c, n in zip(given, (f"__{i}" for i in range(len(given))))))
    out = named.join(wide_, site).orderBy(*site)
    return out.select(*(F.col(f"__{i}").alias(n) for i, n in enumerate(JUNCTION_COLUMNS)), *(F.col(f"`{c}`") for c in wide_.columns if c not in site))
