"""Small synthetic proteomes with planted families, a near-duplicate and a fused protein."""

import random

AMINO = "ACDEFGHIKLMNPQRSTVWY"


def evolve(seq: str, rate: float, rng: random.Random) -> str:
    return "".join(rng.choice(AMINO) if rng.random() < rate else c for c in seq)


def make(n_species: int = 5, n_families: int = 6, length: int = 220, seed: int = 7):
    """(files: name to FASTA text, families: protein name to set of families)."""
    rng = random.Random(seed)
    roots = ["".join(rng.choice(AMINO) for _ in range(length)) for _ in range(n_families)]
    files, families = {}, {}
    for s in range(n_species):
        out = []

        def put(name, seq, fam):
            families[name] = fam
            body = "\n".join(seq[i : i + 60] for i in range(0, len(seq), 60))
            out.append(f">{name} protein of species {s}\n{body}\n")

        for f, root in enumerate(roots):
            own = evolve(root, 0.12, rng)
            put(f"s{s}f{f}", own, {f})
            if f == 0:  # a recent copy in each species, so that trees are needed
                put(f"s{s}f{f}b", evolve(own, 0.06, rng), {f})
            if f == 1 and s == 0:  # shares a run of 100 characters with the first
                put(f"s{s}f{f}dup", own[:150], {f})
        if s == 1:
            put("s1fused", evolve(roots[2], 0.12, rng) + evolve(roots[3], 0.12, rng), {2, 3})
        files[f"species{s}.fasta"] = "".join(out)
    return files, families
