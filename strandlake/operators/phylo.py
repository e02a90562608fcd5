"""Phylogenetic scoring of alignment columns. Distinct columns are few beside positions, so each is scored once and joined
back; motif scores are sums over windows of columns."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Node:
    label: str = ""
    length: float = 0.0
    children: list[Node] = field(default_factory=list)

    def leaves(self) -> list[str]:
        return [self.label] if not self.children else [x for c in self.children for x in c.leaves()]

    def total_length(self) -> float:
        return self.length + sum(c.total_length() for c in self.children)


def parse_newick(text: str) -> Node:
    """A tree in Newick notation."""
    pos, text = 0, text.strip().rstrip(";")

    def node() -> Node:
        nonlocal pos
        n = Node()
        if pos < len(text) and text[pos] == "(":
            while text[pos] in "(,":
                pos += 1
                n.children.append(node())
            pos += 1
        start = pos
        while pos < len(text) and text[pos] not in ",()":
            pos += 1
        name, _, length = text[start:pos].partition(":")
        n.label, n.length = name.strip(), float(length or 0)
        return n

    return node()


def trim(tree: Node, keep: set[str]) -> Node | None:
    """Only the leaves of ``keep``; a node left with one child passes its length on."""
    if not tree.children:
        return tree if tree.label in keep else None
    kids = [t for c in tree.children if (t := trim(c, keep))]
    if len(kids) > 1:
        return Node(tree.label, tree.length, kids)
    return Node(kids[0].label, kids[0].length + tree.length, kids[0].children) if kids else None


def star(tree: Node) -> Node:
    """Every leaf from the root, at the mean distance."""
    names = tree.leaves()
    return Node(children=[Node(n, tree.total_length() / max(1, len(names))) for n in names])


def rerooted(tree: Node, leaf: str) -> Node:
    """The same tree hung from the parent of ``leaf``."""
    def path(n: Node) -> list[Node]:
        if n.label == leaf and not n.children:
            return [n]
        return next(([n, *p] for c in n.children if (p := path(c))), [])

    up = path(tree)[:-1]
    if not up:
        return tree
    top = up[-1]
    out = Node(top.label, 0.0, list(top.children))
    at, below = out, top
    for n in reversed(up[:-1]):
        turned = Node(n.label, below.length, [c for c in n.children if c is not below])
        at.children.append(turned)
        at, below = turned, n
    return out


def rate_matrix(model: str, pi: np.ndarray, kappa: float = 2.0) -> np.ndarray:
    """Instantaneous rates in the order ACGT, one change expected in unit time. jc, k2, f81, f84, hky, tn."""
    pi = np.full(4, 0.25) if model in ("jc", "k2") else pi
    q = np.tile(pi, (4, 1)).astype(float)
    group = {0: pi[0] + pi[2], 2: pi[0] + pi[2], 1: pi[1] + pi[3], 3: pi[1] + pi[3]}
    for a, b in ((0, 2), (2, 0), (1, 3), (3, 1)):
        if model in ("k2", "hky", "tn"):
            q[a, b] *= kappa
        elif model == "f84":
            q[a, b] *= 1 + kappa / group[a]
    np.fill_diagonal(q, 0)
    np.fill_diagonal(q, -q.sum(axis=1))
    return q / -(pi * np.diag(q)).sum()


def halpern_bruno(q: np.ndarray, bg: np.ndarray, fg: np.ndarray) -> np.ndarray:
    """Rates under selection towards ``fg`` from mutation rates ``q`` with equilibrium ``bg``."""
    out = np.zeros((4, 4))
    for a in range(4):
        for b in range(4):
            if a != b:
                r = (fg[b] * bg[a]) / (fg[a] * bg[b])
                out[a, b] = q[a, b] * (1.0 if abs(r - 1) < 1e-9 else np.log(r) / (1 - 1 / r))
    np.fill_diagonal(out, -out.sum(axis=1))
    return out


def transition(q: np.ndarray, t: float) -> np.ndarray:
    """exp(q t), by scaling and squaring a series."""
    n = max(0, int(np.ceil(np.log2(max(1e-12, np.abs(q * t).max() * 4)))))
    x, term, out = q * t / 2**n, np.eye(4), np.eye(4)
    for k in range(1, 20):
        term = term @ x / k
        out = out + term
    for _ in range(n):
        out = out @ out
    return out


def likelihood(tree: Node, column: dict[str, str], q: np.ndarray, pi: np.ndarray) -> float:
    """Felsenstein's pruning; a gap or unknown base says nothing."""
    def part(n: Node) -> np.ndarray:
        if not n.children:
            i = "ACGT".find(column.get(n.label, "-").upper())
            return np.ones(4) if i < 0 else np.eye(4)[i]
        out = np.ones(4)
        for c in n.children:
            out = out * (transition(q, c.length) @ part(c))
        return out

    return float(pi @ part(tree))


def column_table(cols: DataFrame, species: list[str]) -> DataFrame:
    """aln_id, col, key: the bases of a column in the order of ``species``, - where one is absent."""
    table = cols.groupBy("aln_id", "col").pivot("species", species).agg(F.first("base"))
    return table.select("aln_id", "col", F.concat(*[F.coalesce(F.upper(F.col(f"`{s}`")), F.lit("-")) for s in species]).alias("key"))


def score_columns(keys: DataFrame, tree: Node, species: list[str], fg: np.ndarray, bg: np.ndarray, model: str = "f81", use_hb: bool = False) -> DataFrame:
    """key, scores: log2 odds of each distinct column under each motif column against the background. Columns with a gap are
    scored as they are; whoever reads them chooses."""
    q = rate_matrix(model, bg)
    rates = [halpern_bruno(q, bg, f) if use_hb else rate_matrix(model, f) for f in np.maximum(fg, 1e-4)]

    def run(frames):
        for f in frames:
            out = []
            for k in f["key"]:
                col = dict(zip(species, k, strict=True))
                null = likelihood(tree, col, q, bg)
                out.append([float(np.log2(likelihood(tree, col, r, p / p.sum()) / null)) for r, p in zip(rates, np.maximum(fg, 1e-4), strict=True)])
            yield pd.DataFrame({"key": f["key"], "scores": out})

    return keys.select("key").distinct().mapInPandas(run, "key string, scores array<double>")


def scan_alignment(keys: DataFrame, scored: DataFrame, width: int, gaps: str = "skip") -> DataFrame:
    """aln_id, start, score: sums over windows of columns; ``skip`` leaves out windows with a gap, ``wildcard`` counts
    columns of gaps as they score."""
    w = Window.partitionBy("aln_id").orderBy("col")
    j = keys.join(scored, "key")
    total = sum((F.lead(F.col("scores")[i], i).over(w) for i in range(width)), F.lit(0.0))
    bad = F.max(F.col("key").contains("-").cast("int")).over(w.rowsBetween(0, width - 1))
    out = j.select("aln_id", F.col("col").alias("start"), total.alias("score"), bad.alias("bad"), F.lead("col", width - 1).over(w).alias("end"))
    out = out.where(F.col("end") == F.col("start") + width - 1)
    return (out.where("bad = 0") if gaps == "skip" else out).select("aln_id", "start", "score")


def conservation(keys: DataFrame, tree: Node, species: list[str], bg: np.ndarray, width: int = 5, slow: float = 0.2) -> DataFrame:
    """aln_id, col, score: mean over a window of the log odds of slow against normal evolution."""
    q = rate_matrix("f81", bg)

    def run(frames):
        for f in frames:
            cols = [dict(zip(species, k, strict=True)) for k in f["key"]]
            yield pd.DataFrame({"key": f["key"], "s": [float(np.log2(likelihood(tree, c, q * slow, bg) / likelihood(tree, c, q, bg))) for c in cols]})

    s = keys.select("key").distinct().mapInPandas(run, "key string, s double")
    w = Window.partitionBy("aln_id").orderBy("col").rowsBetween(-(width // 2), width // 2)
    return keys.join(s, "key").select("aln_id", "col", F.avg("s").over(w).alias("score"))


def branch_length_score(tree: Node, present: set[str]) -> float:
    """Share of the tree's length that joins the species which hold a site."""
    sub = trim(tree, present)
    return (sub.total_length() - sub.length) / max(1e-12, tree.total_length()) if sub and len(sub.leaves()) > 1 else 0.0


def error_rates(tree: Node, fg: np.ndarray, bg: np.ndarray, model: str = "f81", use_hb: bool = False, bins: int = 1000) -> list[tuple[float, float, float]]:
    """(threshold, true positives, false positives): the chance that a site which evolves under the motif ``fg``, or under the
    background, scores ``threshold`` or more, for each attainable score, in steps of a ``bins``-th of a column's range. Every
    pattern of bases at the leaves is counted, so trees should have few."""
    leaves = tree.leaves()
    patterns = [dict(zip(leaves, x, strict=True)) for x in itertools.product("ACGT", repeat=len(leaves))]
    q = rate_matrix(model, bg)
    null = np.array([likelihood(tree, c, q, bg) for c in patterns])
    columns = []
    for f in np.maximum(fg, 1e-4):
        p = f / f.sum()
        own = np.array([likelihood(tree, c, halpern_bruno(q, bg, f) if use_hb else rate_matrix(model, f), p) for c in patterns])
        columns.append((np.log2(own / null), own))
    step = max(float(np.ptp(s)) for s, _ in columns) / bins or 1.0
    yes, no, low = np.ones(1), np.ones(1), 0
    for s, own in columns:
        at = np.rint(s / step).astype(int)
        low += at.min()
        yes, no = (np.convolve(x, np.bincount(at - at.min(), weights=w)) for x, w in ((yes, own), (no, null)))
    tails = np.cumsum(yes[::-1])[::-1], np.cumsum(no[::-1])[::-1]
    return [(float((low + i) * step), float(tails[0][i]), float(tails[1][i])) for i in np.flatnonzero(yes + no > 0)]
