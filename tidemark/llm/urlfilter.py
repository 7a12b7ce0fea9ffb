"""URL filters: all glob rules at once, as bits of one Shift-And automaton over every canonical URL."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: stands between host and path of a canonical URL. Its byte, 0xFF, is in no text.
SEAM = "\udcff"
WORD = 64


@dataclass(frozen=True)
class Rule:
    """``glob`` over the canonical URL ``.host SEAM path``: ``*`` is any string, ``?`` any one character."""

    name: str
    verdict: str
    glob: str


def prefix_rule(verdict: str, name: str) -> Rule:
    """``host/path``: the host and its subdomains, with paths that start with the rule's."""
    host, slash, path = name.partition("/")
    return Rule(name, verdict, f"*.{host}{SEAM}{slash}{path}*")


# The base rules, then the globs that judge the rest, the first match among them deciding.
BASE = tuple(
    prefix_rule(v, n)
    for v, n in (
        ("allow", "org/"),
        ("block", "example.org/es/"),
        ("block", "example.org/en/1"),
        ("allow", "com/fr/"),
        ("block", "com/de/"),
    )
)
METHOD = (
    Rule("spam hosts", "block", f"*spam*{SEAM}*"),
    Rule("pill shops", "block", f"*pills*{SEAM}*"),
    Rule("casinos", "block", f"*casino*{SEAM}*"),
    Rule("archives", "block", f"*{SEAM}*.zip"),
    Rule("logins", "block", f"*{SEAM}*/login*"),
)


def _bytes(canonical: str) -> bytes:
    return canonical.encode("utf-8", "surrogateescape")


class ShiftAnd:
    """Bit i of the state is on when the first i characters of the packed globs up to it match what was read.

    A glob of m characters between stars takes m + 1 bits, the first of which is its start; a star keeps the bit
    before it on. Bits cross from one 64-bit word into the next by a carry. Memory is (bits / 64) words per URL and
    256 masks, so the rules may be many; they are a parameter and not data.
    """

    def __init__(self, globs: list[str]) -> None:
        start, stay, last, chars = [], [], [], []
        for glob in globs:
            start.append(len(chars))
            chars.append(None)
            stay.append(False)
            for byte in _bytes(glob):
                if byte == ord("*"):
                    stay[-1] = True
                else:
                    chars.append(byte)
                    stay.append(False)
            last.append(len(chars) - 1)
        self.words = -(-len(chars) // WORD)
        self.start = self._bits(start)
        self.last = np.array(last)
        everything = [i for i, c in enumerate(chars) if c == ord("?")]
        self.masks = np.zeros((256, self.words), np.uint64)
        for byte in range(256):
            self.masks[byte] = self._bits(everything + [i for i, c in enumerate(chars) if c == byte])
        # a character's further bytes leave the bit behind a ? on
        stars = [i for i, s in enumerate(stay) if s]
        self.stay = np.tile(self._bits(stars), (256, 1))
        self.stay[0x80:0xC0] = self._bits(stars + everything)
        self.masks[0x80:0xC0] &= ~self._bits(everything)

    def _bits(self, places: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for i in places:
            out[i // WORD] |= np.uint64(1) << np.uint64(i % WORD)
        return out

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For every string and glob, whether the whole string matches."""
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        state = np.tile(self.start, (len(lengths), 1))
        places, lengths = offsets[:-1][order], lengths[order]
        for t in range(int(lengths[0]) if len(lengths) else 0):
            n = int(np.searchsorted(-lengths, -t, "left"))  # strings with more than t characters come first
            now = state[:n]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(WORD - 1)
            read = data[places[:n] + t]
            state[:n] = (moved & self.masks[read]) | (now & self.stay[read])
        hit = (state[:, self.last // WORD] >> (self.last % WORD).astype(np.uint64)) & np.uint64(1)
        out = np.empty(hit.shape, bool)
        out[order] = hit.astype(bool)
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z) and path; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def judge_urls(
    pages: DataFrame,
    base: tuple[Rule, ...] = BASE,
    method: tuple[Rule, ...] = METHOD,
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """One row per input row: id, host, path, ``rule`` and ``verdict``.

    The longest base rule (by its name) decides, the earlier of two alike; else the first glob of ``method`` that
    matches, ``rule`` being null, else ``default``. A null or relative URL is an empty host and path, which globs may
    match. URLs are read whole; repeated rows repeat their verdict; other columns are not read.
    """
    host, path = host_and_path(pages[url_col])
    d = pages.select(pages[id_col].alias(id_col), host.alias("host"), path.alias("path"))
    rules = sorted(base, key=lambda r: -len(r.name))
    names, verdicts = [r.name for r in rules] + [None], [r.verdict for r in [*rules, *method]] + [default]
    globs = [r.glob for r in [*rules, *method]]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ShiftAnd(globs)
        for batch in batches:
            canonical = [_bytes(f".{h}{SEAM}{p}") for h, p in zip(batch["host"].to_pylist(), batch["path"].to_pylist())]
            offsets = np.cumsum([0, *map(len, canonical)])
            hit = automaton.matches(np.frombuffer(b"".join(canonical), np.uint8), offsets)
            which = np.where(hit.any(axis=1), hit.argmax(axis=1), len(globs)) if len(globs) else np.full(len(hit), 0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch[id_col],
                    batch["host"],
                    batch["path"],
                    pa.array([names[min(k, len(rules))] for k in which], pa.string()),
                    pa.array([verdicts[k] for k in which], pa.string()),
                ],
                names=[id_col, "host", "path", "rule", "verdict"],
            )

    kind = d.schema[id_col].dataType.simpleString()
    return d.mapInArrow(judged, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
