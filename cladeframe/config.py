"""Parameters of an orthology run, with their defaults."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class OrthologyConfig:
    steps: str = "1,2,3,4"
    threads: int = 1
    dir: str | None = None
    ext: str = ".fasta"
    kmer_size: int = 100
    kmer_min_aa: int = 15
    hits: str | None = None  # a table of search hits from another program, instead of the built-in search
    trees: str | None = None  # rooted or unrooted Newick trees from another program, instead of the built-in trees
    e_value: float = 0.001
    nb_hits: int = 6
    max_gap: float = 0.7
    phylogenies: str = "nj"
    sp_overlap: float = 0.5
    min_weight: float = 0.1
    min_nb_hits: int = 2
    chimeric_shared: float = 0.5
    chimeric_nb_sp: int = 3
    ratio_ortho: float = 0.5
    not_same_sp: bool = False
    out: str = "."

    def step_list(self) -> list[int]:
        """The steps in order; they must be consecutive and within 1 to 4."""
        try:
            found = sorted({int(x) for x in self.steps.split(",")})
        except ValueError as e:
            raise ValueError("steps must be integers, comma separated") from e
        if found != list(range(found[0], found[-1] + 1)) or found[0] < 1 or found[-1] > 4:
            raise ValueError("steps must be consecutive, from 1 to 4")
        return found

    def validate(self) -> OrthologyConfig:
        steps = self.step_list()
        if 1 in steps and not self.dir:
            raise ValueError("an input directory is needed for step 1")
        if self.phylogenies not in ("nj", "me", "ml"):
            raise ValueError("phylogenies is one of nj, me, ml")
        if 2 in steps and self.phylogenies != "nj" and not self.trees:
            raise ValueError("me and ml trees are read from a table (trees); the built-in method is nj")
        return self


def parse_args(argv: list[str] | None = None) -> OrthologyConfig:
    """Command line to configuration: ``-name value`` for each parameter."""
    parser = argparse.ArgumentParser(prog="cladeframe", description="Orthologous groups and pairs on Spark")
    for f in fields(OrthologyConfig):
        if f.name == "not_same_sp":
            parser.add_argument("-not_same_sp", action="store_true", help="no pairs within a species")
            continue
        kind = type(f.default) if f.default is not None else str
        parser.add_argument(f"-{f.name}", type=kind, default=f.default, help=f"default: {f.default}")
    for name in ("path_diamond", "path_fasttree"):
        parser.add_argument(f"-{name}", help="refused: no other program is started; give its output by -hits or -trees")
    given = vars(parser.parse_args(argv))
    for name, instead in (("path_diamond", "hits"), ("path_fasttree", "trees")):
        if given[name] is not None:
            raise ValueError(f"-{name}: no other program is started; run it and give its output by -{instead}")
    return OrthologyConfig(**{f.name: given[f.name] for f in fields(OrthologyConfig)}).validate()
