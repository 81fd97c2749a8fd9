"""Text formats of graphs, alignments and sequences, parsed by SQL functions while they are scanned.

Every reader takes a path and gives a DataFrame; a filter on the record type or on columns reaches the
scan, and files are split as Spark splits text. A malformed row raises an error that names the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandframe.functions import cigar


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "")


def _fail(condition: Column, message: str, value: Column) -> Column:
    return F.when(condition, F.raise_error(F.concat(F.lit(message + ": "), value)).cast("string")).otherwise(value)


def gfa_records(lines: DataFrame) -> DataFrame:
    """(record_type, fields) of GFA lines."""
    return lines.select(F.substring("value", 1, 1).alias("record_type"), F.split("value", "\t").alias("f"))


def gfa_segments(lines: DataFrame) -> DataFrame:
    """(name, sequence, length); a sequence may be empty."""
    s = gfa_records(lines).where("record_type = 'S'")
    sequence = F.coalesce(F.get("f", F.lit(2)), F.lit(""))
    return s.select(F.get("f", F.lit(1)).alias("name"), sequence.alias("sequence"), F.length(sequence).alias("length"))


def gfa_links(lines: DataFrame) -> DataFrame:
    g = lambda i: F.get("f", F.lit(i))
    return gfa_records(lines).where("record_type = 'L'").select(g(1).alias("node_a"), (g(2) == "-").alias("rev_a"), g(3).alias("node_b"), (g(4) == "-").alias("rev_b"), F.coalesce(g(5), F.lit("*")).alias("cigar"))


def gfa_path_steps(lines: DataFrame) -> DataFrame:
    """(path, step_index, node, reversed, cigar_to_next). A sign ends a name only before a comma or the end, so names may hold signs."""
    g = lambda i: F.get("f", F.lit(i))
    p = gfa_records(lines).where("record_type = 'P'").select(g(1).alias("path"), F.split(g(2), r"(?<=[+-]),").alias("steps"), F.filter(F.split(F.coalesce(g(3), F.lit("")), ","), lambda c: ~c.isin("", "*")).alias("cigars"))
    wrong = (F.size("cigars") > 0) & (F.size("cigars") != F.size("steps") - 1)
    e = p.select(_fail(wrong, "a path needs one overlap less than steps", F.col("path")).alias("path"), "cigars", F.posexplode("steps").alias("step_index", "step"))
    return e.select("path", "step_index", F.expr("substring(step, 1, length(step) - 1)").alias("node"), F.endswith("step", F.lit("-")).alias("reversed"), F.get("cigars", "step_index").alias("cigar_to_next"))


def read_gfa(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segments, links and path steps of a GFA file."""
    lines = _lines(spark, path)
    return gfa_segments(lines), gfa_links(lines), gfa_path_steps(lines)


def read_gfa_cached(spark: SparkSession, path: str, cache: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same tables from a Parquet cache, a folder for each kind of record; it is written anew when the file is newer."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    done = hadoop(f"{cache}/paths/_SUCCESS")
    fs = done.getFileSystem(conf)
    source = hadoop(path)
    tables = dict(zip(("segments", "links", "paths"), read_gfa(spark, path), strict=True))
    if not fs.exists(done) or fs.getFileStatus(done).getModificationTime() < source.getFileSystem(conf).getFileStatus(source).getModificationTime():
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{cache}/{name}")
    return tuple(spark.read.schema(t.schema).parquet(f"{cache}/{name}") for name, t in tables.items())


def segment_lengths(segments: DataFrame) -> DataFrame:
    """(name, length): the sequence column itself is not read from a cache."""
    return segments.select("name", "length")


def dangling(segments: DataFrame, links: DataFrame, steps: DataFrame) -> DataFrame:
    """What refers to a segment that is not there, or to a link that a path needs and no one lists; empty for a sound graph."""
    from strandframe.operators.graph import half_edges

    w = Window.partitionBy("path").orderBy("step_index")
    pairs = steps.select("path", "node", "reversed", F.lead("node").over(w).alias("after"), F.lead("reversed").over(w).alias("after_rev")).where("after IS NOT NULL")
    needed = pairs.select("path", "node", F.when(F.col("reversed"), 0).otherwise(1).alias("side"), F.col("after").alias("other"), F.when(F.col("after_rev"), 1).otherwise(0).alias("other_side"))
    there = half_edges(links)
    unlisted = needed.join(there, ["node", "side", "other", "other_side"], "left_anti").select(F.lit("path").alias("kind"), F.concat_ws(" ", "path", "node", "other").alias("name")).distinct()
    repeated = segments.groupBy("name").count().where("count > 1").select(F.lit("segment").alias("kind"), "name")
    names = segments.select("name")
    ends = links.select(F.col("node_a").alias("name")).unionAll(links.select(F.col("node_b").alias("name"))).distinct()
    missing = ends.join(names, "name", "left_anti").select(F.lit("link").alias("kind"), "name")
    astray = steps.select(F.col("node").alias("name")).distinct().join(names, "name", "left_anti").select(F.lit("step").alias("kind"), "name")
    return missing.unionAll(astray).unionAll(unlisted).unionAll(repeated)


def sam_alignments(lines: DataFrame) -> DataFrame:
    """(query_name, flag, ref_name, mapq, cigar, ref_start) of SAM lines; headers are skipped."""
    g = lambda i: F.get("f", F.lit(i))
    d = lines.where(~F.startswith("value", F.lit("@"))).select(F.split("value", "\t").alias("f"))
    return d.select(g(0).alias("query_name"), g(1).cast("int").alias("flag"), g(2).alias("ref_name"), g(4).cast("int").alias("mapq"), F.coalesce(g(5), F.lit("*")).alias("cigar"), (g(3).cast("int") - 1).alias("ref_start"))


def sam_refs(lines: DataFrame) -> DataFrame:
    """(name, length) of the header's references."""
    d = lines.where(F.startswith("value", F.lit("@SQ")))
    return d.select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("name"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("long").alias("length"))


def alignment_blocks(alignments: DataFrame) -> DataFrame:
    """Alignments with operation totals and reference and query ranges; query ranges are those of the forward read."""
    a = alignments.withColumn("ops", cigar.parse(F.col("cigar"))).withColumn("is_reverse", F.col("flag").bitwiseAND(16) != 0)
    t = lambda *k: cigar.total(F.col("ops"), k)
    clip = lambda end: F.coalesce(F.when(F.element_at("ops", end).op.isin("S", "H"), F.element_at("ops", end).len), F.lit(0))
    filled = F.size("ops") > 0
    first, last = F.when(filled, F.when(F.get("ops", F.lit(0)).op.isin("S", "H"), F.get("ops", F.lit(0)).len).otherwise(0)).otherwise(0), F.when(F.size("ops") > 1, clip(-1)).otherwise(0)
    d = a.select("*", t("M", "=").alias("n_matches"), t("X").alias("n_mismatches"), t("I").alias("n_inserts"), t("D").alias("n_deletes"), first.cast("long").alias("_l"), last.cast("long").alias("_r"))
    d = d.withColumn("ref_stop", F.col("ref_start") + F.col("n_matches") + F.col("n_mismatches") + F.col("n_deletes"))
    d = d.withColumn("query_start", F.when(F.col("is_reverse"), F.col("_r")).otherwise(F.col("_l")))
    return d.withColumn("query_stop", F.col("query_start") + F.col("n_matches") + F.col("n_mismatches") + F.col("n_inserts")).drop("_l", "_r")


def fasta_records(spark: SparkSession, path: str) -> DataFrame:
    """(name, sequence): a record is what lies between two '>' at line begins; the name ends at the first blank."""
    r = spark.read.option("lineSep", "\n>").text(path).where(F.trim("value") != "")
    head = F.regexp_replace(F.substring_index("value", "\n", 1), "^>", "")
    body = F.when(F.instr("value", "\n") > 0, F.expr("substring(value, instr(value, '\n') + 1)")).otherwise("")
    return r.select(F.substring_index(F.trim(head), " ", 1).alias("name"), F.regexp_replace(body, r"\s", "").alias("sequence"))


def fasta_lengths(records: DataFrame) -> DataFrame:
    """(name, length); a name that comes twice is an error."""
    g = records.groupBy("name").agg(F.count("*").alias("n"), F.max(F.length("sequence")).alias("length"))
    return g.select(_fail(F.col("n") > 1, "a sequence's name comes more than once", F.col("name")).alias("name"), "length")


def kmer_set(spark: SparkSession, path: str, parent: str) -> DataFrame:
    """(kmer, parent): the distinct k-mers of a FASTA file, which must be of one length."""
    kmers = _lines(spark, path).where(~F.startswith("value", F.lit(">"))).select(F.trim("value").alias("kmer")).distinct()
    k = kmers.select(F.length("kmer").alias("k")).limit(1).first()
    return kmers.select(_fail(F.length("kmer") != (k.k if k else 0), "k-mers are not of one length", F.col("kmer")).alias("kmer"), F.lit(parent).alias("parent"))


def estimated_records(spark: SparkSession, path: str) -> float:
    """Records of a FASTA file by its size and that of its first record; ``kmer_set(...).count()`` is exact."""
    head = spark.read.text(path).limit(2).collect()
    first = sum(len(r.value.encode()) + 1 for r in head)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).getLen() / first if first else 0.0


def paf_alignments(lines: DataFrame) -> DataFrame:
    """The twelve fixed PAF columns and the CIGAR tag."""
    names = ["query:string", "qlen:long", "qstart:long", "qstop:long", "strand:string", "ref:string", "rlen:long", "rstart:long", "rstop:long", "nmatch:long", "blen:long", "mapq:int"]
    d = lines.select(F.split("value", "\t").alias("f"))
    tag = F.get(F.filter(F.slice("f", 13, F.size("f")), lambda x: x.startswith("cg:Z:")), F.lit(0))
    return d.select(*[F.get("f", F.lit(i)).cast(n.split(":")[1]).alias(n.split(":")[0]) for i, n in enumerate(names)], F.regexp_replace(tag, "^cg:Z:", "").alias("cigar"))


def bed_regions(lines: DataFrame) -> DataFrame:
    d = lines.where(~F.startswith("value", F.lit("#"))).select(F.split("value", "\t").alias("f"))
    return d.select(F.get("f", F.lit(0)).alias("chrom"), F.get("f", F.lit(1)).cast("long").alias("start"), F.get("f", F.lit(2)).cast("long").alias("stop"))


def vcf_positions(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contig, length) of the header, and (chrom, pos, qual) of the records."""
    h = lines.where(F.startswith("value", F.lit("##contig")))
    contigs = h.select(F.regexp_extract("value", r"ID=([^,>]+)", 1).alias("contig"), F.regexp_extract("value", r"length=(\d+)", 1).cast("long").alias("length"))
    d = lines.where(~F.startswith("value", F.lit("#"))).select(F.split("value", "\t").alias("f"))
    return contigs, d.select(F.get("f", F.lit(0)).alias("chrom"), F.get("f", F.lit(1)).cast("long").alias("pos"), F.try_to_number(F.get("f", F.lit(5)), F.lit("999999.99")).cast("double").alias("qual"))


#: Schemas of the CSV tables: name -> (schema, has a header).
CSV = {
    "contacts": ("name_a string, name_b string, weight long", True),
    "contacts_by_mapq": ("name_a string, name_b string, dist string", False),
    "ids": ("id long, name string", False),
    "phases": ("Name string, Phase int, Coverage long, Length long, Color string", True),
    "bubbles": ("Name string, BubbleId long, Phase int, Color string", True),
    "alignments": ("name_a string, name_b string, total_matches long, symmetrical int, color string", True),
    "overlaps": ("name string, other_name string, score long, total_hashes long, similarity double", True),
    "orientations": ("name_a string, name_b string, weight_0 long, weight_1 long, p_null double", True),
    "components": ("component long, side int, nodes string", True),
}


def read_csv(spark: SparkSession, path: str, kind: str) -> DataFrame:
    schema, header = CSV[kind]
    return spark.read.schema(schema).option("header", header).csv(path)


def csv_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(tokens, position) of any comma-separated file; blank lines are left out, ``position`` ascends with the lines."""
    return _lines(spark, path).select(F.split("value", ",").alias("tokens"), F.monotonically_increasing_id().alias("position"))


def read_contacts(spark: SparkSession, path: str, names: DataFrame) -> DataFrame:
    """(a, b, weight) of a contact CSV: each pair once, its first weight; names must be among ``names(name)``, rows must have three fields."""
    rows = csv_tokens(spark, path).where(~((F.size("tokens") == 3) & (F.get("tokens", F.lit(0)) == "name_a")))
    g = lambda i: F.get("tokens", F.lit(i))
    wrong = F.raise_error(F.concat(F.lit("a contact needs three fields: "), F.array_join("tokens", ","))).cast("string")
    c = rows.select("position", g(0).alias("x"), g(1).alias("y"), F.when(F.size("tokens") == 3, g(2)).otherwise(wrong).cast("long").alias("weight"))
    known = names.select(F.col("name").alias("k"), F.lit(True).alias("there"))
    for side in ("x", "y"):
        c = c.join(known, F.col(side) == F.col("k"), "left").withColumn(side, _fail(F.col("there").isNull(), "a contact names an unknown node", F.col(side))).drop("k", "there")
    return c.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min_by("weight", "position").alias("weight"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id, name); ids must be one apart from 0 or 1 on, and neither ids nor names may repeat."""
    ids = read_csv(spark, path, "ids")
    found = ids.agg(F.count("*").alias("n"), F.countDistinct("id").alias("d"), F.countDistinct("name").alias("m"), F.min("id").alias("a"), F.max("id").alias("b")).first()
    if found.n and (found.n != found.d or found.n != found.m or found.a not in (0, 1) or found.b - found.a + 1 != found.n):
        raise ValueError(f"the ids of {path} are not one apart from 0 or 1 on, or repeat")
    return ids


def read_bubbles(spark: SparkSession, path: str) -> DataFrame:
    """(bubble_id, node_0, node_1); the header must name the phase, and phases be 0 and 1."""
    head = spark.read.text(path).limit(1).collect()
    if not head or head[0].value.split(",")[2:3] != ["Phase"]:
        raise ValueError(f"the third column of {path} is not Phase")
    rows = read_csv(spark, path, "bubbles")
    checked = rows.withColumn("Name", _fail(~F.coalesce(F.col("Phase").isin(0, 1), F.lit(False)), "a bubble's phase is neither 0 nor 1", F.col("Name")))
    return bubble_pairs(checked)


def phase_sets(phases: DataFrame) -> DataFrame:
    """(name, side): side 0 for phase -1 and 1 for phase 1; phase 0 is left out."""
    return phases.where("Phase IN (-1, 1)").select(F.col("Name").alias("name"), F.when(F.col("Phase") == 1, 1).otherwise(0).alias("side"))


def read_phases(spark: SparkSession, path: str) -> DataFrame:
    """(name, phase) of a headless phase CSV, for the evaluation of contacts."""
    return csv_tokens(spark, path).select(F.get("tokens", F.lit(0)).alias("name"), F.get("tokens", F.lit(1)).cast("int").alias("phase"))


def symmetrical_alts(alignments: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, weight) of the alignment CSV's symmetrical rows whose ends are both among ``nodes(node)``, each pair once."""
    has = lambda x: nodes.select(F.col("node").alias(x))
    kept = alignments.where("symmetrical = 1").join(has("name_a"), "name_a", "left_semi").join(has("name_b"), "name_b", "left_semi")
    return kept.groupBy(F.least("name_a", "name_b").alias("a"), F.greatest("name_a", "name_b").alias("b")).agg(F.max("total_matches").alias("weight"))


#: Colours of the stains of a chromosome's bands.
STAINS = {"gneg": "#FFFFFF", "gpos25": "#C0C0C0", "gpos50": "#808080", "gpos75": "#404040", "gpos100": "#000000", "acen": "#D92F27", "gvar": "#DCDCDC", "stalk": "#647FA4"}


def ideogram(lines: DataFrame) -> DataFrame:
    """(chrom, start, stop, name, stain, colour) of a cytoband file of four or five columns; the stain is the last one."""
    d = lines.where(~F.startswith("value", F.lit("#"))).select(F.split("value", "\t").alias("f"))
    g = lambda i: F.get("f", F.lit(i))
    stain = F.element_at("f", -1)
    colours = F.create_map(*[F.lit(x) for pair in STAINS.items() for x in pair])
    return d.select(g(0).alias("chrom"), g(1).cast("long").alias("start"), g(2).cast("long").alias("stop"), F.when(F.size("f") > 4, g(3)).alias("name"), stain.alias("stain"), F.coalesce(F.try_element_at(colours, stain), F.lit("#FFFFFF")).alias("colour"))


def asmgene_rows(lines: DataFrame) -> DataFrame:
    """(metric, reference, sample) of the report rows of an assembly gene evaluation."""
    d = lines.where(F.startswith("value", F.lit("X"))).select(F.split(F.trim("value"), r"\s+").alias("f"))
    return d.select(F.get("f", F.lit(1)).alias("metric"), F.get("f", F.lit(2)).cast("long").alias("reference"), F.get("f", F.lit(3)).cast("long").alias("sample"))


def first_qv(lines: DataFrame) -> DataFrame:
    """(qv) of a report's first QV line."""
    return lines.where(F.startswith("value", F.lit("QV"))).select(F.get(F.split(F.trim("value"), r"\s+"), F.lit(1)).cast("double").alias("qv")).limit(1)


def sv_scores(spark: SparkSession, path: str) -> DataFrame:
    """(precision, recall, f1) of a structural variant evaluation's JSON."""
    return spark.read.schema("precision double, recall double, f1 double").option("multiLine", True).json(path)


def phasing_report(spark: SparkSession, path: str, sample: str) -> DataFrame:
    """(sample, chromosome, metric, value) of the TSV of a phasing comparison."""
    t = spark.read.option("sep", "\t").option("header", True).csv(path)
    names = ["all_switch_rate", "blockwise_hamming_rate", "covered_variants"]
    return t.select(F.lit(sample).alias("sample"), F.col("chromosome"), F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")).select("sample", "chromosome", "m.metric", "m.value")


def mapq_counts(contacts: DataFrame) -> DataFrame:
    """(name_a, name_b, mapq, n) of distributions written ``q:n q:n``."""
    e = contacts.select("name_a", "name_b", F.explode(F.split("dist", " ")).alias("x"))
    return e.select("name_a", "name_b", F.split_part("x", F.lit(":"), F.lit(1)).cast("int").alias("mapq"), F.split_part("x", F.lit(":"), F.lit(2)).cast("long").alias("n"))


def bubble_pairs(bubbles: DataFrame) -> DataFrame:
    """(bubble_id, node_0, node_1): the names at phase 0 and 1."""
    at = lambda p: F.min(F.when(F.col("Phase") == p, F.col("Name")))
    return bubbles.groupBy(F.col("BubbleId").alias("bubble_id")).agg(at(0).alias("node_0"), at(1).alias("node_1"))
