"""URL filters by a bit-parallel wildcard automaton.

All glob rules (``*`` any run, ``?`` any byte) are packed into one row of 64-bit words:
a bit per state, a mask per byte. A step over one byte of a URL is a shift with carry,
an AND with the byte's mask, and the states before a ``*`` stay on. It advances every
rule at once, and arrays advance all URLs of a batch at once.

The canonical form of a URL is ``.host``, a byte that UTF-8 never has, and the path:
host from the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path from
there to ``?``, ``#`` or the end. A rule ``host/path`` becomes the glob ``*.host<sep>/path*``, so
it fits the host and its subdomains, and nothing inside a path can pose as a host. Of
the rules that fit, the longest gives the verdict; without one, ``default`` does.

Edge cases: a null URL, or one without ``://``, has an empty host and path and fits no
rule; URLs of any length are read to their end; repeated rows are judged alike; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEPARATOR = b"\xff"
_U = np.uint64


class Globs:
    """Glob patterns over bytes as multiword Shift-And masks."""

    def __init__(self, patterns: list[bytes]):
        starts, bits = [], 0
        steps: list[tuple[int, int | None]] = []  # state and the byte that leads to it
        loops, self.final = [], []
        for p in patterns:
            starts.append(bits)
            state = bits
            for c in p:
                if c == ord("*"):
                    loops.append(state)
                else:
                    state += 1
                    steps.append((state, None if c == ord("?") else c))
            self.final.append(state)
            bits = state + 1
        self.words = max(1, -(-bits // 64))
        self.first, self.loop = self._row(starts), self._row(loops)
        self.mask = np.zeros((256, self.words), _U)
        for state, c in steps:
            self.mask[slice(None) if c is None else c, state >> 6] |= _U(1) << _U(state & 63)

    def _row(self, states: list[int]) -> np.ndarray:
        out = np.zeros(self.words, _U)
        for s in states:
            out[s >> 6] |= _U(1) << _U(s & 63)
        return out

    def match(self, texts: list[bytes]) -> np.ndarray:
        """Boolean matrix: text by pattern."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-sizes, kind="stable")
        flat = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
        begin = (np.cumsum(sizes) - sizes)[order]
        live = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), "left")
        on = np.tile(self.first, (len(texts), 1))
        for t, n in enumerate(live.tolist()):  # texts longer than t come first
            now = on[:n]
            moved = now << _U(1)
            moved[:, 1:] |= now[:, :-1] >> _U(63)
            on[:n] = (moved & self.mask[flat[begin[:n] + t]]) | (now & self.loop)
        out = np.zeros((len(texts), len(self.final)), bool)
        for k, s in enumerate(self.final):
            out[order, k] = (on[:, s >> 6] >> _U(s & 63)) & _U(1) == 1
        return out


def _judge(rules: list[tuple[str, str]], default: str):
    ranked = sorted(rules, key=lambda r: len(r[1].encode()))

    def glob(rule: str) -> bytes:
        host, _, path = rule.partition("/")
        return b"*." + host.encode() + SEPARATOR + b"/" + path.encode() + b"*"

    def run(batches):
        import pyarrow as pa

        globs = Globs([glob(r) for _, r in ranked])
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            found = globs.match([b"." + h.encode() + SEPARATOR + p.encode() for h, p in zip(hosts, paths, strict=True)])
            # the last rule that fits is the longest one
            best = np.where(found.any(1), found.shape[1] - 1 - found[:, ::-1].argmax(1), -1).tolist() if ranked else [-1] * len(hosts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"), batch.column("host"), batch.column("path"),
                    pa.array([None if k < 0 else ranked[k][1] for k in best], pa.string()),
                    pa.array([default if k < 0 else ranked[k][0] for k in best], pa.string()),
                ],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    return run


def judge(pages: DataFrame, rules: list[tuple[str, str]], default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages(page_id, url).

    rules: (verdict, "host/path prefix")."""
    url = F.coalesce("url", F.lit(""))
    host = F.translate(
        F.regexp_extract(url, "://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    parts = pages.select("page_id", host.alias("host"), F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1).alias("path"))
    kind = dict(parts.dtypes)["page_id"]
    return parts.mapInArrow(_judge(rules, default), f"page_id {kind}, host string, path string, rule string, verdict string")
