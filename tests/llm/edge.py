"""Small tables that hold the awkward cases, and plain-code versions to compare with."""

from __future__ import annotations

LONG = "word " * 30_000 + "end"
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away today"),
    (2, "the quick brown fox jumps over the lazy dog and runs far away today"),
    (3, "The Quick brown fox jumps over the lazy dog and runs far away today!"),
    (4, None),
    (5, ""),
    (6, " \t\n "),
    (7, "one"),
    (8, "one"),
    (None, "a text without an id that nobody can name but everyone may read"),
    (None, None),
    (9, LONG),
    (9, LONG),
    (10, "ÉCOLE İstanbul 😀 \x01\x02 ﬁn Σας ÿ"),
    (11, "the quick brown fox jumps over the lazy dog and runs far away today"),
]


def documents(spark, rows=None, clash: str = ""):
    """doc_id and text, with other columns that are null, and one with a name in use inside."""
    rows = TEXTS if rows is None else rows
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    extra = ["cast(null as string) AS lang", "cast(null as string) AS source", "cast(null as bigint) AS n_chars"]
    extra += [f"'x' AS {name}" for name in clash.split()]
    return frame.selectExpr("*", *extra)


def components(links, ids):
    """Smallest id that each id reaches."""
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label
