"""Small documents with the cases that every operator has to stand."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join(rng.choice("the of and river stone häuser été 12 blue run quick lamp tree under over".split()) + rng.choice(["", "s", "ing", "x7"]) for _ in range(n))


def documents(n=60, seed=3):
    """Rows with copies, near copies, nulls in every column, empty and long texts, ties."""
    rng = random.Random(seed)
    base = [words(rng, rng.randint(12, 90)).replace(" river", "\nriver") for _ in range(n)]
    rows = [(i, t, "en", f"src{i % 4}", len(t)) for i, t in enumerate(base)]
    shared = words(rng, 30)
    for i in range(0, n, 7):
        rows.append((1000 + i, base[i], "en", "src0", len(base[i])))  # exact copy
        edited = base[i].split(" ")
        edited[len(edited) // 2] = "changed"
        rows.append((2000 + i, " ".join(edited), "de", None, None))  # near copy
        rows.append((3000 + i, base[(i + 1) % n] + " " + shared + " " + base[(i + 2) % n], None, "src1", 5))
    long_ = words(rng, 9000)
    rows += [(5000, None, "en", "src0", None), (5001, "", None, None, 0), (5002, " \t\n", "en", "src2", 3), (5003, long_, "en", "src3", 1), (5004, long_, "fr", "src3", 1), (None, base[0], "en", "src0", 1), (None, None, None, None, None)]
    rows += [rows[1], rows[1], (5005, "a" * 3000, "en", "src1", 3000), (5006, "\n".join([base[3]] * 4), "en", "src1", 1), (5007, "b<|x|> $$$ ### one\ntwo", "en", "src1", 1)]
    return rows


def same(got, want):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)
