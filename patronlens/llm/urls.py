"""URL filter: all glob rules at once, as one bit-parallel wildcard automaton.

The patterns are laid one after another over a bit mask of several 64-bit words (Shift-And).
Reading a character moves every state bit one place where the pattern has that character; a
`*` keeps the place before it alive. The states of all URLs of a batch advance together, so
the cost of a character does not depend on how many rules match. Patterns match the whole
canonical URL `host/path`, in ASCII lower case for the host only.

Two kinds of rules compile to patterns. A host rule such as `example.org/es/` fits its host
and all subdomains if the path starts with the rule's path; of those that fit, the longest
decides. Glob rules (`*casino*`) block where no host rule fits; everything else is allowed.

Defined results: a URL that is null or has no `://` has an empty host and path, which fits no
host rule. Characters beyond ASCII match themselves byte by byte. Rows are judged each for
itself, so repeated rows give repeated results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronlens.llm.common import lower_ascii

#: Rules on host and path, as the contract states them.
HOST_RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
#: Globs on `host` + `path` that block where no host rule fits.
BLOCK_GLOBS = ("*casino*", "*adult*", "*free-bets*", "*spam-farm*", "*malware*", "*phishing*")
#: Between host and path while host rules are matched; neither can hold it.
BORDER = "#"
#: URLs advance in groups of at most this many, sorted by length, so state stays small.
GROUP = 4096


@dataclass(frozen=True)
class Automaton:
    """Bit masks over words of 64 bits; bit i of the state: the first i places have matched."""

    moves: np.ndarray  # (256, words): places that a byte leads into
    loops: np.ndarray  # (words,): places that any byte keeps
    starts: np.ndarray  # (words,): places alive before the first byte
    ends: tuple[int, ...]  # the last place of each pattern

    @staticmethod
    def compile(patterns: Sequence[str]) -> Automaton:
        sizes = [len(p.replace("*", "").encode()) + 1 for p in patterns]
        words = max(1, -(-sum(sizes) // 64))
        moves = np.zeros((256, words), np.uint64)
        loops, starts = np.zeros(words, np.uint64), np.zeros(words, np.uint64)
        ends, place = [], 0

        def put(mask: np.ndarray, at: int) -> None:
            mask[at >> 6] |= np.uint64(1 << (at & 63))

        for pattern in patterns:
            put(starts, place)
            for byte in pattern.encode():
                if byte == ord("*"):
                    put(loops, place)
                else:
                    place += 1
                    put(moves[byte], place)
            ends.append(place)
            place += 1
        return Automaton(moves, loops, starts, tuple(ends))

    def match(self, texts: Sequence[bytes]) -> np.ndarray:
        """(texts, patterns): which patterns match each whole text."""
        out = np.zeros((len(texts), len(self.ends)), bool)
        order = np.argsort([len(t) for t in texts], kind="stable")
        for first in range(0, len(texts), GROUP):
            rows = order[first : first + GROUP]
            out[rows] = self._match_group([texts[i] for i in rows])
        return out

    def _match_group(self, texts: list[bytes]) -> np.ndarray:
        lengths = np.array([len(t) for t in texts])
        longest = int(lengths[-1]) if len(texts) else 0
        one, high = np.uint64(1), np.uint64(63)
        state = np.tile(self.starts, (len(texts), 1))
        stop = np.searchsorted(lengths, np.arange(longest), side="right")  # texts that ended
        for at in range(longest):
            alive = state[stop[at] :]
            byte = np.fromiter((t[at] for t in texts[stop[at] :]), np.uint8, len(alive))
            moved = alive << one
            moved[:, 1:] |= alive[:, :-1] >> high
            # The first place of a pattern is entered by no byte, so nothing moves across.
            state[stop[at] :] = (moved & self.moves[byte]) | (alive & self.loops)
        ends = np.array(self.ends)
        return (state[:, ends >> 6] >> (ends & 63).astype(np.uint64) & one).astype(bool)


def host_patterns(rule: str) -> tuple[str, str]:
    """The globs of a host rule: the host itself and its subdomains."""
    host, slash, path = rule.partition("/")
    tail = f"{host}{BORDER}{slash}{path}*"
    return tail, f"*.{tail}"


def judge_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    host_rules: Sequence[tuple[str, str]] = HOST_RULES,
    block_globs: Sequence[str] = BLOCK_GLOBS,
) -> DataFrame:
    """One row per page: id, host, path, rule and verdict."""
    rules = sorted(host_rules, key=lambda r: -len(r[0]))
    machine = Automaton.compile([p for rule, _ in rules for p in host_patterns(rule)])
    globs = Automaton.compile(list(block_globs)) if block_globs else None
    names = [rule for rule, _ in rules]
    verdicts = [verdict for _, verdict in rules]

    rest = F.expr(f"substring(`{url_col}`, locate('://', `{url_col}`) + 3)")
    rest = F.when(F.locate("://", F.col(url_col)) > 0, rest)
    whole = F.coalesce(rest, F.lit(""))
    host = lower_ascii(F.regexp_extract(whole, r"(?s)\A([^/?#]*)", 1))
    path = F.regexp_extract(whole, r"(?s)\A[^/?#]*([^?#]*)", 1)
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            bordered = [f"{h}{BORDER}{p}".encode() for h, p in zip(hosts, paths)]
            texts = [(h + p).encode() for h, p in zip(hosts, paths)]
            fits = machine.match(bordered).reshape(len(texts), len(names), 2).any(2)
            first = np.where(fits.any(1), fits.argmax(1), -1)
            bad = globs.match(texts).any(1) if globs else np.zeros(len(texts), bool)
            rule = [names[i] if i >= 0 else None for i in first]
            verdict = [
                verdicts[i] if i >= 0 else ("block" if b else "allow") for i, b in zip(first, bad)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    schema = parts.withColumn("rule", F.lit("")).withColumn("verdict", F.lit("")).schema
    for name in ("rule", "verdict"):
        schema[name].nullable = True
    return parts.mapInArrow(judge, schema)
