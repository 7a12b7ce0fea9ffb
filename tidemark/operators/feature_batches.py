"""The feature set over sorted rows, one Arrow batch at a time.

Spark deals the rows out by series and sorts them; a task then walks its rows in batches and carries the rows that the
frames of the next batch reach, so memory does not grow with a series. Sums run over a frame from its oldest row on, as
Spark's own frames do, so the values are those of the window expressions in ``features``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa


def _pushed(a: np.ndarray, n: int, fill) -> np.ndarray:
    """The array moved by n rows along its last axis: towards later rows, or earlier ones if n is negative."""
    out = np.full_like(a, fill)
    if abs(n) >= a.shape[-1]:
        return a if n == 0 else out
    if n >= 0:
        out[..., n:] = a[..., : a.shape[-1] - n]
    else:
        out[..., :n] = a[..., -n:]
    return out


def _codes(column: pa.Array) -> np.ndarray:
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


@dataclass
class _Rows:
    """Rows of one batch with those before it: index in the stretch of equal keys, values, and which of them are there."""

    index: np.ndarray
    values: dict[str, np.ndarray]
    there: dict[str, np.ndarray]

    def lag(self, name: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        ok = _pushed(self.there[name], n, False) & (self.index >= n)
        return np.where(ok, _pushed(self.values[name], n, 0.0), 0.0), ok

    def lead(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        ok = _pushed(self.there[name], -1, False) & (_pushed(self.index, -1, 0) > 0)
        return np.where(ok, _pushed(self.values[name], -1, 0.0), 0.0), ok

    def frame(self, x: np.ndarray, ok: np.ndarray, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Values of the trailing frame, oldest first, and which of them count; one channel per line of ``x``."""
        for n in range(rows - 1, -1, -1):
            yield _pushed(x, n, 0.0), _pushed(ok, n, False) & (self.index >= n)

    def means(self, x: np.ndarray, ok: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        total, n = np.zeros(x.shape), np.zeros(x.shape)
        for v, here in self.frame(x, ok, rows):
            total += np.where(here, v, 0.0)
            n += here
        return np.where(n > 0, total / np.maximum(n, 1.0), np.nan), n

    def rolling(self, names: Sequence[str], rows: int) -> dict[str, np.ndarray]:
        """Trailing mean, sample deviation and median of the channels."""
        x, ok = (np.stack([d[c] for c in names]) for d in (self.values, self.there))
        total, n, mean, spread = (np.zeros(x.shape) for _ in range(4))
        window = np.empty((*x.shape, rows))
        for k, (v, here) in enumerate(self.frame(x, ok, rows)):
            more = n + 1.0
            off = v - mean
            step = off / more
            total += np.where(here, v, 0.0)
            spread += np.where(here, off * (off - step), 0.0)
            mean += np.where(here, step, 0.0)
            n += here
            window[..., k] = np.where(here, v, np.nan)
        window.sort(axis=-1)
        at = [np.maximum(np.floor(m / 2), 0).astype(np.int64)[..., None] for m in (n - 1, n)]
        low, high = (np.take_along_axis(window, np.minimum(i, rows - 1), -1)[..., 0] for i in at)
        average = np.where(n > 0, total / np.maximum(n, 1.0), np.nan)
        deviation = np.where(n > 1, np.sqrt(spread / np.maximum(n - 1.0, 1.0)), 0.0)
        out = {}
        for k, c in enumerate(names):
            out |= {f"{c}_roll_mean": average[k], f"{c}_roll_std": deviation[k], f"{c}_roll_median": (low[k] + high[k]) * 0.5}
        return out

    def changes(self, c: str) -> dict[str, np.ndarray]:
        """First and central difference."""
        x, own = self.values[c], self.there[c]
        (prev, before), (nxt, after) = self.lag(c, 1), self.lead(c)
        ends = np.where(before, np.where(own, x - prev, np.nan), np.where(own, nxt - x, np.nan))
        central = np.where(before & after, (nxt - prev) / 2.0, ends)
        return {
            f"{c}_roc": np.where(before & own, x - prev, 0.0),
            f"{c}_grad": np.where(before | after, central, 0.0),
        }

    def ewma(self, names: Sequence[str], start: np.ndarray, alpha: float, strides: Sequence[int], fan: int) -> dict[str, np.ndarray]:
        """The lagged sums of ``features.add_ewma``."""
        keep, out = 1.0 - alpha, {}
        for c in names:
            own = self.there[c]
            y = np.where(own, np.where(start, self.values[c], alpha * self.values[c]), 0.0)
            for stride in strides:
                total = y
                for i in range(1, fan):
                    total = total + keep ** (stride * i) * np.where(self.index >= stride * i, _pushed(y, stride * i, 0.0), 0.0)
                y = np.where(own, total, 0.0)
            out[f"{c}_ewma"] = np.where(own, y, np.nan)
        return out

    def correlation(self, a: str, b: str, rows: int, floor: float, least: int) -> np.ndarray:
        """Trailing correlation; a frame without a pair of values counts as 1, as the expression has it."""
        x, y, in_x, in_y = self.values[a], self.values[b], self.there[a], self.there[b]
        both = in_x & in_y
        parts = np.stack([x, y, x * x, y * y, x * y])
        (mx, my, xx, yy, xy), n = self.means(parts, np.stack([in_x, in_y, in_x, in_y, both]), rows)
        spread = [np.where(k > 0, np.maximum(s - m * m, floor), floor) for s, m, k in ((xx, mx, n[0]), (yy, my, n[1]))]
        share = (xy - mx * my) / np.sqrt(spread[0] * spread[1])
        return np.where(np.minimum(self.index + 1, rows) >= least, np.maximum(np.fmin(share, 1.0), -1.0), 0.0)


@dataclass(frozen=True)
class FeatureBatches:
    """What a task needs: the plan, fixed values, the key columns, and the position column if the rows carry one."""

    plan: object
    keys: tuple[str, ...]
    position: str | None
    reach: int
    strides: tuple[int, ...]
    fan: int
    cap: int
    wrap: int
    floor: float
    least: int

    def channels(self) -> list[str]:
        p = self.plan
        names = [*p.rolling, *p.lagged, *p.changing, *p.smoothed, *p.correlated, p.alarm, p.counter]
        return list(dict.fromkeys(c for c in names if c))

    def names(self) -> list[str]:
        p = self.plan
        out = [f"{c}_ewma" for c in p.smoothed]
        out += [f"{c}_roll_{kind}" for c in p.rolling for kind in ("mean", "std", "median")]
        out += [f"{c}_lag{n}" for c in p.lagged for n in p.lags]
        out += [f"{c}_{kind}" for c in p.changing for kind in ("roc", "grad")]
        out += ["time_since_alarm", "alarm_freq"] if p.alarm else []
        return [*out, "temp_curr_corr", *(["heartbeat_delta"] if p.counter else [])]

    def features(self, rows: _Rows, pos: np.ndarray, last: np.ndarray) -> dict[str, np.ndarray]:
        p = self.plan
        out = rows.ewma(p.smoothed, pos == 1, 2.0 / (p.span + 1.0), self.strides, self.fan)
        if p.rolling:
            out |= rows.rolling(p.rolling, p.roll_rows)
        out |= {f"{c}_lag{n}": rows.lag(c, n)[0] for c in p.lagged for n in p.lags}
        for c in p.changing:
            out |= rows.changes(c)
        if p.alarm:
            out["time_since_alarm"] = np.where(last >= 0, np.minimum(pos - last, self.cap), self.cap).astype(float)
            out["alarm_freq"] = rows.means(rows.values[p.alarm][None], rows.there[p.alarm][None], p.alarm_rows)[0][0]
        out["temp_curr_corr"] = rows.correlation(*p.correlated, p.corr_rows, self.floor, self.least)
        if p.counter:
            before, ok = rows.lag(p.counter, 1)
            step = rows.values[p.counter] - before
            out["heartbeat_delta"] = np.where(ok & rows.there[p.counter], np.where(step < 0, step + self.wrap, step), 1.0)
        return out

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row once, when the row after it is known."""
        tail, index0, last0, given = None, 0, -1, 0
        for batch in self._closed(batches):
            final = batch is None
            if tail is None and final:
                return
            rows = tail if final else batch if tail is None else pa.concat_batches([tail, batch])
            n = rows.num_rows
            fresh = np.zeros(n, bool)
            for key in self.keys:
                code = _codes(rows.column(rows.schema.get_field_index(key)))
                fresh[1:] |= code[1:] != code[:-1]
            at = np.arange(n)
            fresh[0] = tail is None
            starts = np.where(fresh, at, -(1 << 60))
            starts[0] = -index0
            index = at - np.maximum.accumulate(starts)
            values, there = {}, {}
            for c in self.channels():
                column = rows.column(rows.schema.get_field_index(c))
                there[c] = column.is_valid().to_numpy(zero_copy_only=False)
                values[c] = np.where(there[c], column.cast(pa.float64()).to_numpy(zero_copy_only=False), 0.0)
            if self.position:
                pos = rows.column(rows.schema.get_field_index(self.position)).to_numpy(zero_copy_only=False)
            else:
                pos = index + 1
            last = np.full(n, -1)
            if self.plan.alarm:
                on = there[self.plan.alarm] & (values[self.plan.alarm] == 1)
                seen = np.where(on, pos, -1)
                if tail is not None:
                    seen[0] = last0
                last = seen[np.maximum.accumulate(np.where(on | fresh | (at == 0), at, 0))]
            end = n if final else n - 1
            if end > given:
                with np.errstate(all="ignore"):
                    made = self.features(_Rows(index, values, there), pos, last)
                old = [c.slice(given, end - given) for c in rows.columns]
                new = [pa.array(np.where(np.isnan(x := made[c][given:end]), 0.0, x)) for c in self.names()]
                yield pa.RecordBatch.from_arrays([*old, *new], names=[*rows.schema.names, *self.names()])
            first = max(0, end - self.reach)
            tail, given = rows.slice(first), end - first
            if first < n:
                index0, last0 = int(index[first]), int(last[first])

    @staticmethod
    def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
        for batch in batches:
            if batch.num_rows:
                yield batch
        yield None
