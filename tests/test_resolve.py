import random

import pytest

from histmerge.operators.resolve import (
    ambiguous_names,
    default_per_group,
    lookup_hits,
    tiered_lookup,
)
from tests.conftest import rows


def steps_of(path):
    """A path's components: the root, and all names but empty ones and later dots."""
    found = [s for n, s in enumerate(path.split("/")) if s and (s != "." or n == 0)]
    return (["/"] if path.startswith("/") else []) + found


def expect(catalog, q):
    """The tiers by brute force: (status, tier, name, names of all hits)."""
    steps = steps_of(q)
    by_name = [n for n, _ in catalog if n == q]
    by_path = [
        n for n, p in catalog if p is not None and (not steps or steps_of(p)[-len(steps) :] == steps)
    ]
    by_part = [n for n, _ in catalog if n is not None and q in n]
    for tier, hits in (("name", by_name), ("path", by_path), ("part", by_part)):
        if len(hits) == 1:
            return "found", tier, hits[0], set(by_name + by_path + by_part)
    hits = set(by_name + by_path + by_part)
    return "ambiguous" if hits else "not found", None, None, hits


CATALOG = [
    ("default", "/home/a/x1.default"),
    ("default-release", "/home/a/x2.default-release"),
    ("work", "/home/a/profiles/x3.work"),
    ("work", "/home/b/profiles/x4.work"),
    ("play", "/home/b/play/"),
    ("dotted", "/home/u/a/./b"),
    ("led", "./led/x"),
    ("lost", None),
    (None, "/home/c/nameless"),
]
QUERIES = [
    "default", "default-release", "work", "x3.work", "profiles/x4.work", "b/play", "play/",
    "/home/b/play", "/b/play", "defau", "rele", "efault-", "nothing", "", "3.work", "a/x1.default",
    "longer than any name in the catalog is", "home", "a/b", "u/a/b", "a/./b/.", "./a/b", "led/x",
    "./led/x", "home//u/./a/b", "/", ".", "d", "ed", "ult", "c/nameless", "os", "ost",
]


def compare(spark, work, catalog, queries):
    df = spark.createDataFrame(catalog, "name string, path string")
    asked = spark.createDataFrame([(q,) for q in queries], "q string")
    answers = work.keep(tiered_lookup(lookup_hits(df, asked), asked), "answers")
    got = {r["q"]: (r["status"], r["tier"], r["name"]) for r in answers.collect()}
    want = {q: expect(catalog, q) for q in queries}
    assert got == {q: w[:3] for q, w in want.items()}
    names = rows(ambiguous_names(df, answers))
    assert names == sorted(
        ((q, n) for q, w in want.items() if w[0] == "ambiguous" for n in w[3]), key=repr
    )


def test_tiers_against_brute_force(spark, work):
    compare(spark, work, CATALOG, QUERIES)


@pytest.mark.parametrize("seed", range(2))
def test_random_catalogs_against_brute_force(spark, work, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("ab", k=r.randrange(1, 4)))
    slash = lambda: r.choice(["/", "/", "//", "/./"])
    path = lambda: r.choice(["", "/", "./"]) + slash().join(word() for _ in range(r.randrange(1, 4)))
    catalog = [("".join(word() for _ in range(r.randrange(1, 4))), path()) for _ in range(40)]
    queries = {word() for _ in range(8)} | {word() + word() for _ in range(8)} | {path() for _ in range(8)}
    compare(spark, work, catalog, sorted(queries))


def test_default_of_a_group_is_the_first_marked_row(spark):
    df = spark.createDataFrame(
        [(1, 3, True, "c"), (1, 2, True, "b"), (1, 1, False, "a"), (2, 1, False, "z")],
        "g int, pos int, is_default boolean, name string",
    )
    assert rows(default_per_group(df, "g", "pos", "is_default", "name")) == [
        (1, "b", "default"),
        (2, None, "no default"),
    ]
