"""Sinks: hits as tables, GFF3, nested XML or JSON; motifs, priors, tracks and alignments in their own formats."""

from __future__ import annotations

import json
from xml.sax.saxutils import quoteattr

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators.motifs import Motif

HIT_COLUMNS = ["motif_id", "motif_alt_id", "sequence_name", "start", "stop", "strand", "score", "p-value", "q-value", "matched_sequence"]


def hit_table(hits: DataFrame) -> DataFrame:
    """The ten columns of a hit file, absent ones empty, starts before stops."""
    have = {"motif_id": "motif_id", "sequence_name": "seq_name", "start": "start", "stop": "stop", "strand": "strand", "score": "score", "p-value": "pvalue", "q-value": "qvalue", "matched_sequence": "matched", "motif_alt_id": "alt_id"}
    col = lambda c: F.col(have[c]) if have[c] in hits.columns else F.lit("")
    return hits.select(*[(F.least("start", "stop") if c == "start" else F.greatest("start", "stop") if c == "stop" else col(c)).alias(c) for c in HIT_COLUMNS])


def write_hits(hits: DataFrame, path: str) -> None:
    hit_table(hits).write.csv(path, sep="\t", header=True)


def gff3(hits: DataFrame, source: str = "strandlake") -> DataFrame:
    """value: a GFF3 line for each hit; the score column is -10 log10 p, at most 1000."""
    score = F.round(F.least(F.lit(1000.0), -10 * F.log10(F.greatest("pvalue", F.lit(1e-100)))), 2).cast("string")
    note = F.concat(F.lit("Name="), "motif_id", F.lit(";pvalue="), F.col("pvalue").cast("string"))
    return hits.select(F.concat_ws("\t", F.col("seq_name"), F.lit(source), F.lit("nucleotide_motif"), F.col("start").cast("string"), F.col("stop").cast("string"), score, F.col("strand"), F.lit("."), note).alias("value"))


def write_gff3(hits: DataFrame, path: str) -> None:
    gff3(hits).write.text(path)


def nested(hits: DataFrame) -> DataFrame:
    """motif_id, seq_name, matches: a row for each motif and sequence."""
    return hits.groupBy("motif_id", "seq_name").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "strand", "score", "pvalue"))).alias("matches"))


def write_xml(hits: DataFrame, path: str) -> None:
    nested(hits).write.format("xml").option("rootTag", "hits").option("rowTag", "scanned-sequence").save(path)


def write_json(hits: DataFrame, path: str) -> None:
    nested(hits).write.json(path)


def write_cisml(hits: DataFrame, path: str) -> None:
    """Pattern elements, one for each motif and sequence, so that no row holds all hits of a motif; a hit on the minus strand runs
    from its larger place to its smaller one."""
    plus = F.col("strand") != "-"
    hit = F.struct(F.when(plus, F.col("start")).otherwise(F.col("stop")).alias("_start"), F.when(plus, F.col("stop")).otherwise(F.col("start")).alias("_stop"), F.col("score").cast("double").alias("_score"), F.col("pvalue").alias("_pvalue"), F.col("matched").alias("sequence"))
    each = hits.groupBy("motif_id", "seq_name").agg(F.array_sort(F.collect_list(hit)).alias("m"))
    scanned = F.array(F.struct(F.col("seq_name").alias("_accession"), F.col("seq_name").alias("_name"), F.col("m").alias("matched-element")))
    rows = each.select(F.col("motif_id").alias("_accession"), F.col("motif_id").alias("_name"), scanned.alias("scanned-sequence"))
    rows.write.format("xml").option("rootTag", "cis-element-search").option("rowTag", "pattern").save(path)


def meme_text(motifs: list[Motif], bg: dict[str, float] | None = None) -> str:
    """Minimal motif text that ``parse_meme`` reads back."""
    core = motifs[0].alphabet.core if motifs else "ACGT"
    out = ["MEME version 4", "", f"ALPHABET= {core}", ""]
    if core == "ACGT":
        out += ["strands: + -", ""]
    if bg:
        out += ["Background letter frequencies", " ".join(f"{s} {p:g}" for s, p in bg.items()), ""]
    for m in motifs:
        out += [f"MOTIF {m.id} {m.alt_id}".rstrip(), "", f"letter-probability matrix: alength= {len(core)} w= {m.width} nsites= {m.nsites:g} E= {m.evalue:g}"]
        out += [" ".join(f"{x:.6f}" for x in row) for row in m.freqs]
        out += [f"URL {m.url}", ""] if m.url else [""]
    return "\n".join(out)


#: Forms of count matrices: the line before a matrix, and whether its rows are symbols.
COUNT_FORMS = {"jaspar": (">{}", True), "uniprobe": ("{}", True), "scpd": (">{}", True), "taipale": ("{}", True), "priority": ("Transcription factor: {}", True), "chen": (">{}", False), "nmica": (">{}", False), "rna": (">{}", False), "beeml": ("# {}", False), "tamo": ("Motif {}", False), "matrix": (">{}", False)}


def motif_text(motifs: list[Motif], dialect: str = "meme") -> str:
    """Motifs in a dialect that ``load_motifs`` reads back: minimal text, XML of either kind, a page with JSON data, TRANSFAC
    records, or matrices of counts (frequencies, where the number of sites isn't known)."""
    number = lambda x: repr(float(x))
    if dialect == "meme":
        return meme_text(motifs)
    if dialect == "xml":
        cells = lambda m, row: "".join(f'<value letter_id="{s}">{number(x)}</value>' for s, x in zip(m.alphabet.core, row, strict=True))
        each = [f"<motif name={quoteattr(m.id)} alt={quoteattr(m.alt_id)} sites=\"{m.nsites:g}\" e_value=\"{m.evalue:g}\"><probabilities><alphabet_matrix>" + "".join(f"<alphabet_array>{cells(m, r)}</alphabet_array>" for r in m.freqs) + "</alphabet_matrix></probabilities></motif>" for m in motifs]
        return "<motifs>" + "".join(each) + "</motifs>"
    if dialect == "dreme":
        letters = "".join(f'<letter symbol="{s}"/>' for s in (motifs[0].alphabet.core if motifs else ""))
        row = lambda m, r: "<pos " + " ".join(f'{s}="{number(x)}"' for s, x in zip(m.alphabet.core, r, strict=True)) + "/>"
        each = [f"<motif seq={quoteattr(m.id)} alt={quoteattr(m.alt_id)} nsites=\"{m.nsites:g}\" evalue=\"{m.evalue:g}\">" + "".join(row(m, r) for r in m.freqs) + "</motif>" for m in motifs]
        return f"<dreme><model><alphabet>{letters}</alphabet></model><motifs>{''.join(each)}</motifs></dreme>"
    if dialect == "html":
        data = {"motifs": [{"id": m.id, "alt": m.alt_id, "nsites": m.nsites, "evalue": m.evalue, "pwm": m.freqs.tolist()} for m in motifs]}
        return f"<html><script>\nvar data = {json.dumps(data)};\n</script></html>"
    out = []
    for m in motifs:
        counts = m.freqs * (m.nsites or 1.0)
        if dialect == "transfac":
            out += [f"ID {m.id}", "P0 " + " ".join(m.alphabet.core), *[f"{i:02d} " + " ".join(map(number, r)) for i, r in enumerate(counts, 1)], "//"]
        else:
            line, symbols = COUNT_FORMS[dialect]
            out += [line.format(m.id), *([f"{s} " + " ".join(map(number, r)) for s, r in zip(m.alphabet.core, counts.T, strict=True)] if symbols else [" ".join(map(number, r)) for r in counts])]
    return "\n".join(out) + "\n"


def wiggle(priors: DataFrame, span: int = 1, block: int = 1 << 16) -> DataFrame:
    """value: a variableStep record for each ``block`` places of a chromosome, lines in order of position."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("start", "value"))), lambda x: F.concat_ws(" ", x["start"].cast("string"), x["value"].cast("string")))
    records = priors.groupBy("chrom", F.floor(F.col("start") / block).alias("block")).agg(lines.alias("l"))
    return records.select(F.concat_ws("\n", F.concat(F.lit("variableStep chrom="), "chrom", F.lit(f" span={span}")), F.array_join("l", "\n")).alias("value"))


def psp(priors: DataFrame, width: int) -> DataFrame:
    """value: a record of priors for each sequence."""
    p = F.transform(F.array_sort(F.collect_list(F.struct("pos", "prior"))), lambda x: x["prior"].cast("string"))
    return priors.groupBy("seq_name").agg(p.alias("p")).select(F.concat(F.lit(">"), "seq_name", F.lit(f" {width}\n"), F.array_join("p", " ")).alias("value"))


def prior_distribution(head: dict[str, float], bins: list[float]) -> str:
    """Header figures and a line for each bin, which ``read_prior_distribution`` reads back."""
    return "\n".join([f"# {k} {float(v)!r}" for k, v in head.items()] + [repr(float(x)) for x in bins]) + "\n"


def fasta(df: DataFrame, name: str = "seq_name", seq: str = "seq", line: int = 60) -> DataFrame:
    return df.select(F.concat(F.lit(">"), name, F.lit("\n"), F.regexp_replace(seq, f"(.{{{line}}})(?=.)", "$1\n")).alias("value"))


def phylip(aln: DataFrame) -> DataFrame:
    """value: a PHYLIP block for each alignment."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("row", "species", "seq"))), lambda x: F.concat(F.rpad(x["species"], 10, " "), x["seq"]))
    return aln.groupBy("aln_id").agg(rows.alias("r"), F.count("*").alias("n"), F.max(F.length("seq")).alias("w")).select(F.concat_ws("\n", F.concat_ws(" ", F.col("n").cast("string"), F.col("w").cast("string")), F.array_join("r", "\n")).alias("value"))


def clustal(aln: DataFrame, line: int = 50) -> DataFrame:
    """value: a ClustalW file for each alignment, in blocks of ``line`` columns."""
    blocks = aln.select("aln_id", "row", "species", F.posexplode(F.regexp_extract_all("seq", F.lit(f".{{1,{line}}}"), F.lit(0))).alias("b", "s"))
    blocks = blocks.groupBy("aln_id", "b").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "species", "s"))), lambda x: F.concat(F.rpad(x["species"], 16, " "), x["s"])), "\n").alias("t"))
    return blocks.groupBy("aln_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "t"))), lambda x: x["t"]), "\n\n").alias("t")).select(F.concat(F.lit("CLUSTAL W multiple sequence alignment\n\n"), "t", F.lit("\n")).alias("value"))


def msf(aln: DataFrame, line: int = 50) -> DataFrame:
    """value: an MSF file for each alignment, gaps as dots, in blocks of ``line`` columns."""
    rows = aln.select("aln_id", "row", F.rpad("species", 16, " ").alias("name"), F.translate("seq", "-", ".").alias("seq"))
    width = F.max(F.length("seq"))
    entry = F.concat(F.lit(" Name: "), "name", F.lit(" Len: "), F.length("seq").cast("string"), F.lit(" Check: 0 Weight: 1.0"))
    in_order = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", x.alias("t")))), lambda s: s["t"]), "\n")
    head = rows.groupBy("aln_id").agg(F.concat(F.lit("PileUp\n\n MSF: "), width.cast("string"), F.lit(" Type: N Check: 0 ..\n\n"), in_order(entry), F.lit("\n\n//\n\n")).alias("h"))
    parts = rows.select("aln_id", "row", "name", F.posexplode(F.regexp_extract_all("seq", F.lit(f".{{1,{line}}}"), F.lit(0))).alias("b", "s"))
    parts = parts.groupBy("aln_id", "b").agg(in_order(F.concat("name", "s")).alias("t"))
    body = parts.groupBy("aln_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "t"))), lambda x: x["t"]), "\n\n").alias("t"))
    return head.join(body, "aln_id").select(F.concat("h", "t", F.lit("\n")).alias("value"))


def logo_svg(motif: Motif, height: int = 100, column: int = 30) -> str:
    """A sequence logo: each column's letters, least frequent first, as high as their share of the column's bits."""
    colours = {"A": "#00a000", "C": "#0000c0", "G": "#e0a000", "T": "#c00000", "U": "#c00000"}
    unit, out = height / np.log2(motif.freqs.shape[1]), []
    for i, (row, bits) in enumerate(zip(motif.freqs, motif.information(), strict=True)):
        y = float(height)
        for f, s in sorted(zip(row, motif.alphabet.core, strict=True)):
            h = f * bits * unit
            if h > 0.5:
                out.append(f'<text transform="translate({i * column},{y:.2f}) scale({column / 14:.3f},{h / 14:.3f})" font-family="monospace" font-size="20" fill="{colours.get(s, "#404040")}">{s}</text>')
                y -= h
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{motif.width * column}" height="{height}">{"".join(out)}</svg>'


def hit_html(hits: DataFrame, title: str = "hits") -> DataFrame:
    """value: the rows of a table of hits as HTML, a line each, between a line that opens the page and one that ends it."""
    table = hit_table(hits)
    cells = F.concat(*[F.concat(F.lit("<td>"), F.replace(F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</td>")) for c in HIT_COLUMNS])
    head = f"<!DOCTYPE html><title>{title}</title><table><tr>" + "".join(f"<th>{c}</th>" for c in HIT_COLUMNS) + "</tr>"
    ends = hits.sparkSession.range(1).select(F.explode(F.array(F.struct(F.lit(0).alias("o"), F.lit(head).alias("value")), F.struct(F.lit(2).alias("o"), F.lit("</table>").alias("value")))).alias("e")).select("e.*")
    rows = table.select(F.lit(1).alias("o"), F.concat(F.lit("<tr>"), cells, F.lit("</tr>")).alias("value"))
    return ends.unionByName(rows).orderBy("o").select("value")
