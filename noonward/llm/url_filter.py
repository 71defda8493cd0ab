"""URL filters: glob rules simulated all at once by a bit-parallel automaton.

A glob matches a whole canonical URL; `*` stands for any characters, none included, and `?` for one. Each literal
of a rule is a state, a bit in a row of 64-bit words, after one start bit per rule. For the next character c,

    states = (((states << 1) | carry) & takes[c]) | (states & loops)

where `loops` has the states that a `*` follows. All rules and all URLs of a batch advance together; a URL matches
a rule if the rule's last bit is set at its end.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noonward.llm.common import without

#: Stands between host and path of a canonical URL; neither can hold it.
BOUNDARY = "#"
#: Prefix rules go before plain globs.
PREFIX_WEIGHT = 1_000_000
#: Cells (URLs times words) that advance together.
CELLS = 1 << 20


@dataclass(frozen=True)
class Rule:
    """What to do with the URLs that a glob fits. Of several that fit, the highest `weight` wins, then the first."""

    glob: str
    verdict: str
    label: str | None = None
    weight: int = 0


def prefix_rules(host: str, path: str, verdict: str) -> list[Rule]:
    """A host with all its subdomains, and the start of a path; the longest such rule wins."""
    label, glob = host + path, f"{host}{BOUNDARY}{path}*"
    return [Rule(g, verdict, label, PREFIX_WEIGHT + len(label)) for g in (glob, f"*.{glob}")]


class Automaton:
    """The masks of a list of globs."""

    def __init__(self, globs: list[str]):
        takes: dict[str, list[int]] = {}
        anything, loops, starts, ends = [], [], [], []
        bit = 0
        for glob in globs:
            starts.append(bit)
            for c in glob:
                if c == "*":
                    loops.append(bit)
                    continue
                bit += 1
                if c == "?":
                    anything.append(bit)
                else:
                    takes.setdefault(c, []).append(bit)
            ends.append(bit)
            bit += 1
        self.words = max(1, -(-bit // 64))
        self.codes = {c: i + 1 for i, c in enumerate(takes)}
        rows = [anything, *[anything + bits for bits in takes.values()]]
        self.takes = np.stack([self._mask(bits) for bits in rows])
        self.loops, self.starts = self._mask(loops), self._mask(starts)
        self.end_word, self.end_bit = np.array(ends, np.int64) // 64, np.array(ends, np.uint64) % np.uint64(64)

    def _mask(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for b in bits:
            out[b // 64] |= np.uint64(1 << (b % 64))
        return out

    def matches(self, texts: list[str]) -> np.ndarray:
        """For each text and glob, whether it fits."""
        out = np.zeros((len(texts), len(self.end_word)), bool)
        order = np.argsort([len(t) for t in texts], kind="stable")
        step = max(1, CELLS // self.words)
        for at in range(0, len(order), step):
            self._advance([texts[i] for i in order[at : at + step]], order[at : at + step], out)
        return out

    def _advance(self, texts: list[str], places: np.ndarray, out: np.ndarray) -> None:
        """Texts in order of length; those that have ended leave the matrix from above."""
        states = np.tile(self.starts, (len(texts), 1))
        get, one, top = self.codes.get, np.uint64(1), np.uint64(63)
        first = position = 0
        lengths = np.array([len(t) for t in texts])
        while first < len(texts):
            ended = int(np.searchsorted(lengths, position, "right"))
            if ended > first:
                last = states[: ended - first]
                out[places[first:ended]] = (last[:, self.end_word] >> self.end_bit & one).astype(bool)
                states, first = states[ended - first :], ended
                continue
            codes = np.fromiter((get(t[position], 0) for t in texts[first:]), np.int64, len(texts) - first)
            moved = states << one
            moved[:, 1:] |= states[:, :-1] >> top
            states = (moved & self.takes[codes]) | (states & self.loops)
            position += 1


def canonical_parts(url) -> tuple[F.Column, F.Column]:
    """Host (A-Z in lower case) and path of a URL; both empty without `://`."""
    url = F.coalesce(F.col(url), F.lit(""))
    host = F.regexp_extract(url, "://([^/?#]*)", 1)
    path = F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judge(df: DataFrame, rules: list[Rule], default: str = "allow", url: str = "url") -> DataFrame:
    """`df` with host, path, rule (the winning rule's label) and verdict of each URL.

    Rules are matched to the canonical URL, which is host, BOUNDARY and path. Where none fits, rule is null and the verdict is
    `default`; so for missing, empty and malformed URLs (`#`), unless
    a glob fits even these. Rows stay as they are,
    repeated ones too; columns with the names of the four results are replaced. The rules go to every task, and
    their masks take a few bytes per character.
    """
    base = without(df, "host", "path", "rule", "verdict")
    host, path = canonical_parts(url)
    rank = sorted(range(len(rules)), key=lambda i: (-rules[i].weight, i))
    globs, labels = [rules[i].glob for i in rank], [rules[i].label for i in rank] + [None]
    verdicts = [rules[i].verdict for i in rank] + [default]

    def run(batches):
        automaton = Automaton(globs)
        for batch in batches:
            at = zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())
            fits = automaton.matches([h + BOUNDARY + p for h, p in at])
            best = np.where(fits.any(1), fits.argmax(1), len(globs)) if globs else np.zeros(len(fits), np.int64)
            rule, verdict = pa.array([labels[i] for i in best], pa.string()), pa.array([verdicts[i] for i in best], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], names=[*batch.schema.names, "rule", "verdict"])

    parts = base.withColumns({"host": host, "path": path})
    added = [T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())]
    return parts.mapInArrow(run, T.StructType([*parts.schema, *added]))
