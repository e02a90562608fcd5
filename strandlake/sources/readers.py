"""Readers: sequence files as distributed records; motifs, models and definitions, which are small, on the driver.

Sequences are split into records where a line starts with '>', so a file of any size is read in parallel."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions.symbols import DNA, PROTEIN, Alphabet
from strandlake.operators.motifs import Motif


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """seq_name, description, seq. Record lines are joined; empty records are kept, blank text before the first is not."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("r")).where(F.trim("r") != "")
    head, body = F.regexp_extract("r", r"^([^\r\n]*)", 1), F.regexp_replace(F.regexp_replace("r", r"^[^\r\n]*", ""), r"\s", "")
    return raw.select(F.regexp_extract(head, r"^(\S*)", 1).alias("seq_name"), F.regexp_extract(head, r"^\S*\s*(.*)$", 1).alias("description"), body.alias("seq"))


def genomic_coordinates(df: DataFrame, name: str = "seq_name") -> DataFrame:
    """Adds chrom and offset from names such as chr1:100-200; the name itself and 0 where there are none."""
    part = lambda i: F.regexp_extract(name, r"^(.+):(\d+)-(\d+)$", i)
    return df.withColumns({"chrom": F.when(part(1) != "", part(1)).otherwise(F.col(name)), "offset": F.when(part(2) != "", part(2).cast("bigint")).otherwise(F.lit(0).cast("bigint"))})


def split_weights(df: DataFrame) -> tuple[DataFrame, list[float]]:
    """Sequences without their WEIGHTS record, and its numbers."""
    row = df.where("seq_name = 'WEIGHTS'").select("description", "seq").first()
    return df.where("seq_name <> 'WEIGHTS'"), [float(x) for x in (row["description"] + " " + row["seq"]).split()] if row else []


def fetch(df: DataFrame, names: DataFrame) -> DataFrame:
    return df.join(names.select("seq_name"), "seq_name", "left_semi")


def read_psp(spark: SparkSession, path: str) -> DataFrame:
    """seq_name, width, pos (from 1), prior."""
    r = read_fasta_like(spark, path)
    width = F.regexp_extract("head", r"^\S+\s+(\d+)", 1).cast("int")
    p = F.filter(F.split(F.trim("body"), r"\s+"), lambda x: x != "")
    return r.select(F.regexp_extract("head", r"^(\S*)", 1).alias("seq_name"), width.alias("width"), F.posexplode(p).alias("i", "v")).select("seq_name", "width", (F.col("i") + 1).alias("pos"), F.col("v").cast("double").alias("prior"))


def read_fasta_like(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("r")).where(F.trim("r") != "")
    return raw.select(F.regexp_extract("r", r"^([^\r\n]*)", 1).alias("head"), F.regexp_replace("r", r"^[^\r\n]*", "").alias("body"))


def read_wiggle(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, span, value of fixedStep and variableStep tracks. A record runs from one header line to the next."""
    raw = spark.read.option("lineSep", "Step ").text(path).select(F.col("value").alias("r"))
    raw = raw.where(F.col("r").contains("chrom="))
    get = lambda k, d: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("r", rf"(?:^|\s){k}=(\d+)", 1), F.lit("")), F.lit("999999999999")).cast("bigint"), F.lit(d))
    head = raw.select(F.regexp_extract("r", r"chrom=(\S+)", 1).alias("chrom"), get("start", -1).alias("s"), get("step", 1).alias("step"), get("span", 1).alias("span"), F.regexp_replace("r", r"^[^\r\n]*", "").alias("body"))
    lines = head.select("chrom", "s", "step", "span", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?m)^[ \t]*([-+.\d][^\r\n]*?)\r?$"), F.lit(1))).alias("i", "l"))
    f = F.split(F.trim("l"), r"\s+")
    return lines.select("chrom", F.when(F.col("s") >= 0, F.col("s") + F.col("i") * F.col("step")).otherwise(f[0].cast("bigint")).alias("start"), "span", F.element_at(f, -1).cast("double").alias("value"))


def read_scores(spark: SparkSession, path: str, column: int = 1, header: bool = False) -> DataFrame:
    """score: column ``column`` (from 1) of blank-separated lines; comment lines are passed over."""
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    s = F.try_element_at(F.split(F.trim("value"), r"\s+"), F.lit(column))
    return rows.select(s.try_cast("double").alias("score")).where("score is not null" if header else "true")


def read_background(text: str) -> dict[str, float]:
    """Markov tuples of any order."""
    return {f[0]: float(f[1]) for line in text.splitlines() if (f := line.split("#")[0].split()) and len(f) >= 2}


def read_prior_distribution(text: str) -> tuple[dict[str, float], list[float]]:
    """Header figures (min, max, median) and the bins."""
    head = {m[1]: float(m[2]) for m in re.finditer(r"^#\s*(\w+)\s+(\S+)", text, re.M)}
    return head, [float(x.split()[-1]) for x in text.splitlines() if x.strip() and not x.startswith("#")]


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """term, gene: lines of a term and its genes, by tabs."""
    f = F.split("value", "\t")
    return spark.read.text(path).where("trim(value) <> ''").select(f[0].alias("term"), F.explode(F.slice(f, 2, 2**30)).alias("gene")).where("gene <> ''")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated with a header; columns by name."""
    return spark.read.csv(path, sep="\t", header=True, inferSchema=True)


def read_clustal(spark: SparkSession, path: str) -> DataFrame:
    """species, seq, as wide as the alignment: a species' blocks joined in file order."""
    raw = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("aln_id"), F.posexplode(F.split("value", "\r?\n")).alias("n", "l"))
    rows = raw.where(F.col("l").rlike(r"^\S+\s+[A-Za-z.*-]+\s*\d*\s*$") & ~F.col("l").rlike("^CLUSTAL"))
    rows = rows.select("aln_id", "n", F.regexp_extract("l", r"^(\S+)", 1).alias("species"), F.regexp_extract("l", r"^\S+\s+(\S+)", 1).alias("s"))
    return rows.groupBy("aln_id", "species").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "s"))), lambda x: x["s"]), "").alias("seq"), F.min("n").alias("row"))


def alignment_columns(aln: DataFrame) -> DataFrame:
    """aln_id, species, col (from 1), base."""
    return aln.select("aln_id", "species", F.posexplode(F.filter(F.split("seq", ""), lambda c: c != "")).alias("i", "base")).select("aln_id", "species", (F.col("i") + 1).alias("col"), "base")


def drop_gap_columns(cols: DataFrame, species: str) -> DataFrame:
    """Without the columns in which ``species`` has a gap."""
    gaps = cols.where((F.col("species") == species) & F.col("base").isin("-", ".")).select("aln_id", "col")
    return cols.join(gaps, ["aln_id", "col"], "left_anti")


def coordinate_map(cols: DataFrame) -> DataFrame:
    """Adds seq_pos, a base's place in its own sequence; gaps have that of the last base."""
    w = Window.partitionBy("aln_id", "species").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    return cols.withColumn("seq_pos", F.sum((~F.col("base").isin("-", ".")).cast("int")).over(w))


def identity(cols: DataFrame) -> DataFrame:
    """aln_id, identical, columns."""
    d = cols.groupBy("aln_id", "col").agg(F.countDistinct(F.upper("base")).alias("k"), F.max(F.col("base").isin("-", ".")).alias("gap"))
    return d.groupBy("aln_id").agg(F.count(F.when((F.col("k") == 1) & ~F.col("gap"), 1)).alias("identical"), F.count("*").alias("columns"))


# Motif files ---------------------------------------------------------------------------------------------------------


def _rows(lines: list[str]) -> np.ndarray:
    return np.array([[float(x) for x in line.split()] for line in lines])


def parse_meme(text: str) -> list[Motif]:
    """Minimal motif text: MOTIF lines and letter-probability matrices, with nsites and E from their headers."""
    m = re.search(r"ALPHABET=\s*(\S+)", text)
    alphabet = PROTEIN if m and len(m[1]) == 20 else DNA
    out = []
    for block in re.split(r"(?m)^\s*MOTIF\s+", text)[1:]:
        names = block.splitlines()[0].split()
        head = re.search(r"letter-probability matrix:([^\n]*)\n((?:[ \t]*[-+0-9.eE]+(?:[ \t]+[-+0-9.eE]+)+[ \t]*\n?)+)", block)
        if not head:
            continue
        keys = dict(re.findall(r"(\w+)=\s*(\S+)", head[1]))
        url = re.search(r"(?m)^URL\s+(\S+)", block)
        out.append(Motif(names[0], _rows(head[2].strip().splitlines()), names[1] if len(names) > 1 else "", float(keys.get("nsites", 0)), float(keys.get("E", 0)), url[1] if url else "", alphabet))
    return out


def parse_meme_xml(text: str) -> list[Motif]:
    """Motif elements with probability matrices of array rows, or with pos elements whose attributes are letters."""
    out = []
    for m in ET.fromstring(text).iter("motif"):
        table = m.find("probabilities")
        if table is not None:
            freqs = [[float(v.text) for v in row.iter("value")] for row in table.iter("alphabet_array")]
        else:
            freqs = [[float(p.get(s)) for s in DNA.core] for p in m.iter("pos")]
        if freqs:
            out.append(Motif(m.get("name") or m.get("seq") or m.get("id"), np.array(freqs), m.get("alt", ""), float(m.get("sites") or m.get("nsites") or 0), float(m.get("e_value") or m.get("evalue") or 0)))
    return out


def parse_dreme_xml(text: str) -> list[Motif]:
    """Motif elements with a pos element for each column, whose attributes are the core symbols' frequencies (or whose values
    are listed by letter elements of the alphabet)."""
    root = ET.fromstring(text)
    letters = [x.get("symbol") or x.get("id") for x in root.iter("letter")] or list(DNA.core)
    core = [s for s in letters if s and len(s) == 1 and s in (DNA.core if set(DNA.core) <= set(letters) else PROTEIN.core)]
    out = []
    for m in root.iter("motif"):
        rows = [[float(p.get(s, 0)) for s in core] for p in m.iter("pos")]
        if rows:
            out.append(Motif(m.get("seq") or m.get("id"), np.array(rows), m.get("alt", ""), float(m.get("nsites", 0)), float(m.get("evalue", 0)), alphabet=DNA if "".join(core) == DNA.core else PROTEIN))
    return out


def read_cisml(spark: SparkSession, path: str) -> DataFrame:
    """motif_id, seq_name, start, stop, score, pvalue, matched of the matched elements of pattern-scanning results: a row for each
    pattern is read at a time."""
    match = "array<struct<`_start`:int,`_stop`:int,`_score`:double,`_pvalue`:double,sequence:string>>"
    schema = f"`_name` string, `scanned-sequence` array<struct<`_name`:string,`matched-element`:{match}>>"
    raw = spark.read.format("xml").option("rowTag", "pattern").schema(schema).load(path)
    each = raw.select(F.col("_name").alias("motif_id"), F.explode("scanned-sequence").alias("s")).select("motif_id", F.col("s._name").alias("seq_name"), F.explode("s.matched-element").alias("m"))
    return each.select("motif_id", "seq_name", *[F.col(f"m._{c}").alias(c) for c in ("start", "stop", "score", "pvalue")], F.trim("m.sequence").alias("matched"))


def parse_dirichlet(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Weights and alphas of a Dirichlet mixture: lines ``Mixture= weight`` and ``Alpha= total a1 a2 ...`` (the total is left out), or a
    line of numbers for each component, the weight first."""
    weights = [float(x) for x in re.findall(r"(?m)^\s*Mixture\s*=\s*(\S+)", text)]
    alphas = [[float(x) for x in line.split()[1:]] for line in re.findall(r"(?m)^\s*Alpha\s*=\s*(.+)$", text)]
    if not weights:
        rows = [[float(x) for x in line.split()] for line in text.splitlines() if line.strip() and not line.lstrip().startswith("#")]
        weights, alphas = [r[0] for r in rows], [r[1:] for r in rows]
    return np.array(weights), np.array(alphas)


def parse_score_matrix(text: str) -> tuple[str, np.ndarray]:
    """Symbols and scores of a substitution matrix: a line of symbols, then a line for each, with or without its symbol."""
    lines = [line.split() for line in text.splitlines() if line.strip() and not line.startswith("#")]
    symbols = "".join(lines[0])
    return symbols, np.array([[float(x) for x in (line[1:] if len(line) > len(symbols) else line)] for line in lines[1 : len(symbols) + 1]])


def parse_hart_background(text: str, core: str = DNA.core) -> dict[str, float]:
    """Markov tuples of a file that lists, for each order, conditional chances in the order of the tuples, a line for a context."""
    out: dict[str, float] = {}
    tuples = [""]
    rows = [[float(x) for x in line.split()] for line in text.splitlines() if line.strip() and not line.lstrip().startswith(("#", ">"))]
    values = [x for row in rows for x in row]
    at = 0
    while at < len(values):
        longer = [t + s for t in tuples for s in core]
        for t, v in zip(longer, values[at : at + len(longer)], strict=True):
            out[t] = v * (out[t[:-1]] if len(t) > 1 else 1.0)
        at, tuples = at + len(longer), longer
    return out


def parse_meme_html(text: str) -> list[Motif]:
    """Motifs of a report page: JSON data in a script, or minimal motif text in hidden fields."""
    m = re.search(r"var\s+data\s*=\s*(\{.*?\})\s*;\s*(?:\n|</script>)", text, re.S)
    if m:
        data = json.loads(m[1])
        return [Motif(x.get("id", ""), np.array(x["pwm"]), x.get("alt", ""), float(x.get("nsites", 0)), float(x.get("evalue", 0))) for x in data.get("motifs", data.get("queries", []))]
    fields = re.findall(r'<input[^>]*type="hidden"[^>]*value="([^"]*letter-probability[^"]*)"', text)
    return [m for f in fields for m in parse_meme(f if "MOTIF" in f else "MOTIF " + str(len(f)) + "\n" + f)]


def parse_counts(text: str, name_line: str = r"^>\s*(\S+)", transposed: bool = True) -> list[Motif]:
    """Count or frequency matrices after name lines: rows of symbols (optionally labelled, bracketed), or rows of positions."""
    out = []
    for block in re.split("(?m)(?=" + name_line + ")", text):
        m = re.match(name_line, block, re.M)
        if not m:
            continue
        lines = [re.sub(r"^[A-Za-z]\s*[:|]?\s*|[\[\]]", " ", x) for x in block.splitlines()[1:]]
        rows = _rows([x for x in lines if re.fullmatch(r"[\s0-9.eE+-]+", x) and x.strip()])
        if not rows.size:
            continue
        counts = rows.T if transposed else rows
        out.append(Motif(m[1], counts / counts.sum(axis=1, keepdims=True), nsites=float(counts.sum(axis=1).max())))
    return out


def parse_transfac(text: str) -> list[Motif]:
    """Records ended by //: ID or AC names, P0 header of letters, numbered rows of counts."""
    out = []
    for rec in text.split("//"):
        name = re.search(r"(?m)^(?:ID|AC)\s+(\S+)", rec)
        head = re.search(r"(?m)^P[0O]\s+(.+)$", rec)
        if not (name and head):
            continue
        order = [head[1].split().index(s) for s in DNA.core]
        c = np.array([[float(x) for x in line.split()[1 : 1 + len(head[1].split())]] for line in re.findall(r"(?m)^\d\d\s+.*$", rec)])[:, order]
        out.append(Motif(name[1], c / c.sum(axis=1, keepdims=True), nsites=float(c.sum(axis=1).max())))
    return out


def from_sites(name: str, sites: list[str], alphabet: Alphabet = DNA) -> Motif:
    """Aligned sites; an ambiguous symbol is shared among those it stands for."""
    w = len(sites[0])
    c = np.zeros((w, len(alphabet.core)))
    for s in sites:
        for i, x in enumerate(s.upper()):
            own = alphabet.expand(x)
            for y in own:
                c[i, alphabet.core.index(y)] += 1 / len(own)
    return Motif(name, c / c.sum(axis=1, keepdims=True), nsites=float(len(sites)), alphabet=alphabet)


def from_iupac(name: str, pattern: str, alphabet: Alphabet = DNA) -> Motif:
    return from_sites(name, [pattern], alphabet)


def from_regex(name: str, pattern: str, alphabet: Alphabet = DNA) -> Motif:
    """A pattern of letters and [classes]."""
    cols = [m[1] or m[0] for m in re.finditer(r"\[([^\]]+)\]|.", pattern)]
    f = np.array([[1.0 if s in "".join(alphabet.expand(x) for x in c.upper()) else 0.0 for s in alphabet.core] for c in cols])
    return Motif(name, f / f.sum(axis=1, keepdims=True), alphabet=alphabet)


#: Matrix dialects: name line, and whether rows are symbols.
DIALECTS = {
    "jaspar": (r"^>\s*(\S+)", True), "uniprobe": (r"^(?:Protein:|Gene:)?[ \t]*([A-Za-z]\S*)[ \t]*$", True), "chen": (r"^>\s*(\S+)", False), "beeml": (r"^#\s*(\S+)", False), "nmica": (r"^>\s*(\S+)", False),
    "priority": (r"^Transcription factor:\s*(\S+)", True), "rna": (r"^>\s*(\S+)", False), "scpd": (r"^>\s*(\S+)", True), "taipale": (r"^([A-Za-z]\S*)[ \t]*$", True), "tamo": (r"^Motif\s+(\S+)", False), "matrix": (r"^>?\s*([A-Za-z]\S*)", False),
}


def load_motifs(text: str, dialect: str | None = None, pseudo: float = 0.0, bg: np.ndarray | None = None, trim_bits: float | None = None) -> list[Motif]:
    """Motifs of a file's text; without a dialect, the first reader that finds any."""
    readers = {"meme": parse_meme, "xml": parse_meme_xml, "dreme": parse_dreme_xml, "html": parse_meme_html, "transfac": parse_transfac}
    readers |= {k: (lambda t, line=line, rows=rows: parse_counts(t, line, rows)) for k, (line, rows) in DIALECTS.items()}
    readers |= {"sites": lambda t: [from_sites("sites", t.split())], "iupac": lambda t: [from_iupac(x, x) for x in t.split()], "elm": lambda t: [from_regex(f[0], f[-1], PROTEIN) for line in t.splitlines() if len(f := line.split("\t")) > 1], "regexp": lambda t: [from_regex(*line.split()[:2]) for line in t.splitlines() if line.strip()]}
    out: list[Motif] = []
    for name in [dialect] if dialect else ["meme", "xml", "html", "transfac", "jaspar"]:
        try:
            out = readers[name](text)
        except (ET.ParseError, ValueError, KeyError):
            if dialect:
                raise
        if out:
            break
    if pseudo and bg is not None:
        out = [m.with_pseudocount(bg, pseudo) for m in out]
    return [m.trimmed(trim_bits) for m in out] if trim_bits else out
