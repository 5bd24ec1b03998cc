"""Per-key state machines used by :mod:`ledgerline.operators.ordered_fold`.

A kernel sees the rows of one key in order. Its state is one integer; ids only reach it where they repeat. Rows are
taken in stretches: whole columns are looked at up to the first row that does not go the ordinary way, so the cost in
Python is per refusal, per alert and per repeated id, not per row. Where repeated ids are frequent, whole columns would
be looked at for a row or two, so balances are then taken row by row.

Besides folding from one state, a kernel folds from all states at once: its *function* of a stretch of rows tells the
end state for any start, as pieces (``low``, ``end``, ``slope``) that hold from ``low`` up to the next one:
``end + slope * (start - low)``. Functions let a hot key be folded as independent segments, whose true starts follow
without looking at the rows again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

FAR = 1 << 60
# Rows looked at together: few after something out of the ordinary, then more and more.
_SHORT, _LONG = 32, 65_536
_NONE = -1
#: A function that has got more pieces than this is put out, and the next one begins; looked at after so many rows.
MOST_PIECES, STEP = 2048, 512


def end_for(low: np.ndarray, end: np.ndarray, slope: np.ndarray, start: int) -> int:
    """The end state of a stretch that is entered with ``start``."""
    at = int(np.searchsorted(low, start, "right")) - 1
    return int(end[at] + slope[at] * (start - low[at]))


def _or_null(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=values == _NONE)


class BalanceKernel:
    """Stock balance that never goes below zero.

    Stock events may create a key; sale rows (``must_exist``) may not. Only applied rows use up their ids:
    a repeated ``event_id`` (stock events) or ``sale_id`` (sales) is a duplicate, and a sale that passes every
    other check but carries a used ``event_id`` is refused as ``duplicate_event_id``.
    """

    inputs = ("delta", "must_exist", "_again_event_id", "_again_sale_id", "_blocked_event_id", "_blocked_sale_id")
    # Columns a frame may leave out, so that they are neither shuffled nor converted.
    defaults = {"must_exist": False, "_again_event_id": None, "_again_sale_id": None, "_blocked_event_id": False,
                "_blocked_sale_id": False}
    ids = ("event_id", "sale_id")
    outputs = (("status", T.StringType(), pa.string()), ("quantity_before", T.LongType(), pa.int64()),
               ("quantity_after", T.LongType(), pa.int64()))
    statuses = ("applied", "rejected", "duplicate", "product_not_found", "insufficient_stock", "duplicate_event_id")
    accepted = "applied"
    absent = -1

    def begin(self, state: int | None) -> BalanceRun:
        return BalanceRun(self.absent if state is None else state)

    def limit(self) -> BalanceLimit:
        return BalanceLimit()

    def function(self, most: int) -> BalanceFunction:
        return BalanceFunction(most)

    def room(self, rows: int) -> tuple[np.ndarray, ...]:
        """Where the results of a batch go; -1 stands for none."""
        return tuple(np.full(rows, _NONE, kind) for kind in (np.int8, np.int64, np.int64))

    def arrays(self, out: tuple[np.ndarray, ...]) -> list[pa.Array]:
        names = pa.array(self.statuses, pa.string())
        codes = pa.array(out[0], pa.int8(), mask=out[0] == _NONE)
        return [names.take(codes), _or_null(out[1]), _or_null(out[2])]


_APPLIED, _REJECTED, _DUPLICATE, _NOT_FOUND, _TOO_LITTLE, _USED_EVENT = range(6)


class BalanceRun:
    def __init__(self, start: int) -> None:
        self.state = start
        self.events: set[str] = set()
        self.sales: set[str] = set()

    def share_ids(self, other: BalanceRun) -> None:
        self.events, self.sales = other.events, other.sales

    def advance(self, columns: dict[str, np.ndarray], low: int, high: int, out: tuple[np.ndarray, ...] | None) -> None:
        special = columns["_special"]
        if np.count_nonzero(special[low:high]) * _SHORT > high - low:
            self._each(columns, low, high, out)
            return
        while low < high:
            if special[low]:
                self._one(columns, low, out)
                low += 1
                continue
            ahead = special[low:high]
            stop = low + int(ahead.argmax()) if ahead.any() else high
            self._stretch(columns["delta"], columns["must_exist"], low, stop, out)
            low = stop

    def _stretch(self, deltas: np.ndarray, sale_rows: np.ndarray, low: int, high: int, out) -> None:
        """Rows without repeated or used ids."""
        size = _SHORT
        while low < high:
            stop = min(high, low + size)
            delta, sale = deltas[low:stop], sale_rows[low:stop]
            if self.state < 0:
                creates = ~sale & (delta >= 0)
                n = int(creates.argmax()) if creates.any() else len(delta)
                if out is not None:
                    out[0][low:low + n] = np.where(sale[:n], _NOT_FOUND, _REJECTED)
                    # A refused first stock event reports zero; a sale of nothing known reports nothing.
                    out[1][low:low + n] = np.where(sale[:n], _NONE, 0)
                    out[2][low:low + n] = np.where(sale[:n], _NONE, 0)
                low += n
                if n < len(delta):
                    self.state = int(delta[n])
                    if out is not None:
                        out[0][low], out[1][low], out[2][low] = _APPLIED, 0, self.state
                    low += 1
                size = min(2 * size, _LONG)
                continue
            after = self.state + np.cumsum(delta)
            below = after < 0
            n = int(below.argmax()) if below.any() else len(delta)
            if n:
                if out is not None:
                    out[0][low:low + n] = _APPLIED
                    out[1][low:low + n] = after[:n] - delta[:n]
                    out[2][low:low + n] = after[:n]
                self.state = int(after[n - 1])
            low += n
            size = min(2 * size, _LONG)
            if n < len(delta):
                if out is not None:
                    out[0][low] = _TOO_LITTLE if sale[n] else _REJECTED
                    out[1][low] = out[2][low] = self.state
                low, size = low + 1, _SHORT

    def _each(self, columns: dict[str, np.ndarray], low: int, high: int, out) -> None:
        """Row by row, for stretches that are often broken by ids that occur elsewhere too."""
        state, events, sales, results = self.state, self.events, self.sales, []
        for special, delta, is_sale, event_id, sale_id, no_event, no_sale in zip(*(
                columns[name][low:high].tolist() for name in (
                    "_special", "delta", "must_exist", "_again_event_id", "_again_sale_id", "_blocked_event_id",
                    "_blocked_sale_id"))):
            before, after = state, (state if state > 0 else 0) + delta
            if is_sale and special and (no_sale or sale_id in sales):
                results.append((_DUPLICATE, before, before))
            elif is_sale and before < 0:
                results.append((_NOT_FOUND, before, before) if special else (_NOT_FOUND, _NONE, _NONE))
            elif special and not is_sale and (no_event or event_id in events):
                results.append((_DUPLICATE, before, before))
            elif after < 0:
                at = 0 if before < 0 else before
                results.append((_TOO_LITTLE if is_sale else _REJECTED, at, at))
            elif special and is_sale and (no_event or event_id in events):
                results.append((_USED_EVENT, before, before))
            else:
                results.append((_APPLIED, 0 if before < 0 else before, after))
                state = after
                if event_id is not None:
                    events.add(event_id)
                if is_sale and sale_id is not None:
                    sales.add(sale_id)
        self.state = state
        if out is not None:
            for column, values in zip(out, zip(*results)):
                column[low:high] = values

    def _one(self, columns: dict[str, np.ndarray], i: int, out) -> None:
        """A row whose ids occur elsewhere too."""
        before, delta = self.state, int(columns["delta"][i])
        is_sale, event_id = columns["must_exist"][i], columns["_again_event_id"][i]
        sale_id = columns["_again_sale_id"][i]
        used_event = columns["_blocked_event_id"][i] or event_id in self.events
        after, status = before, None
        if is_sale:
            if columns["_blocked_sale_id"][i] or sale_id in self.sales:
                status = _DUPLICATE
            elif before < 0:
                status = _NOT_FOUND
        elif used_event:
            status = _DUPLICATE
        if status is None:
            after = max(before, 0) + delta
            if after < 0:
                status = _TOO_LITTLE if is_sale else _REJECTED
                after = before
            else:
                if is_sale and used_event:
                    status, after = _USED_EVENT, before
                else:
                    status, self.state = _APPLIED, after
                    if event_id is not None:
                        self.events.add(event_id)
                    if is_sale and sale_id is not None:
                        self.sales.add(sale_id)
        if out is not None:
            fresh = status in (_APPLIED, _REJECTED) and before < 0
            out[0][i] = status
            out[1][i] = 0 if fresh else before
            out[2][i] = 0 if status == _REJECTED and before < 0 else after


class BalanceLimit:
    """How large a balance can be after a stretch: at most ``max(start + add, floor)``.

    Either every movement was applied, or one was refused, or made the product known, when the balance was no more than
    that movement's size. A row that may be a repetition may also leave the balance as it is.
    """

    def __init__(self) -> None:
        self.add, self.floor = 0, 0

    def advance(self, columns: dict[str, np.ndarray], low: int, high: int, out=None) -> None:
        delta = columns["delta"][low:high]
        moved = np.cumsum(np.where(columns["_special"][low:high], np.maximum(delta, 0), delta))
        rise = int(moved[-1] - moved.min())
        self.floor = max(self.floor + int(moved[-1]), int(np.abs(delta).max()) + rise)
        self.add += int(moved[-1])


class BalanceFunction:
    """The end of a stretch for every balance up to ``most`` that it may start with, and for an unknown product.

    All starts walk together as pieces of neighbours that met the same decisions. A movement that some of them cannot
    bear parts them; starts that have come to the same balance (and have applied the same repeated ids) are one again,
    so few pieces stay however long the stretch is. Movements that all can bear are taken in whole stretches.
    """

    def __init__(self, most: int) -> None:
        self.low, self.at, self.slope = (np.array([x], np.int64) for x in (0, 0, 1))
        self.beyond, self.moved = max(most, 0) + 1, 0
        self.absent = BalanceRun(BalanceKernel.absent)
        # For each repeated id the pieces that have applied it.
        self.events: dict[str, np.ndarray] = {}
        self.sales: dict[str, np.ndarray] = {}

    def advance(self, columns: dict[str, np.ndarray], low: int, high: int, out=None) -> None:
        self.absent.advance(columns, low, high, None)
        special, deltas = columns["_special"], columns["delta"]
        while low < high:
            if special[low]:
                self._one(columns, low)
                low += 1
                continue
            ahead = special[low:high]
            stop = low + int(ahead.argmax()) if ahead.any() else high
            self._stretch(deltas, low, stop)
            low = stop

    def pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self._join()
        lows = np.concatenate([[BalanceKernel.absent], self.low])
        ends = np.concatenate([[self.absent.state], self.at + self.moved])
        return lows, ends, np.concatenate([[0], self.slope])

    def highest(self) -> int:
        """The largest end."""
        width = np.append(self.low[1:], self.beyond) - self.low
        return max(int((self.at + self.slope * (width - 1)).max()) + self.moved, self.absent.state)

    def is_full(self) -> bool:
        """Whether the stretch should end here: then what follows starts anew, which ids that it must remember forbid."""
        known = self.events or self.sales or self.absent.events or self.absent.sales
        return len(self.low) > MOST_PIECES and not known

    def _stretch(self, deltas: np.ndarray, low: int, high: int) -> None:
        size = _SHORT
        while low < high:
            delta = deltas[low:min(high, low + size)]
            after = int(self.at.min()) + self.moved + np.cumsum(delta)
            below = after < 0
            n = int(below.argmax()) if below.any() else len(delta)
            self.moved += int(delta[:n].sum())
            low += n
            size = min(2 * size, _LONG)
            if n < len(delta):
                self._apply(int(delta[n]), np.zeros(1, bool))
                low, size = low + 1, _SHORT

    def _apply(self, delta: int, idle) -> np.ndarray:
        """One movement; ``idle(pieces)`` or an array tells which starts do not take it. Returns who applied it."""
        if delta < 0:
            self._part(-delta)
        stays = idle() if callable(idle) else idle
        taken = (self.at + self.moved + delta >= 0) & ~stays
        self.moved += delta
        self.at[~taken] -= delta
        return taken

    def _part(self, least: int) -> None:
        """Cut the pieces of which only the upper starts have ``least`` left; join those that are alike."""
        self._join()
        values = self.at + self.moved
        top = values + self.slope * (np.append(self.low[1:], self.beyond) - 1 - self.low)
        cut = np.flatnonzero((values < least) & (top >= least))
        if len(cut):
            self._take(np.sort(np.concatenate([np.arange(len(self.low)), cut])))
            upper = cut + np.arange(1, len(cut) + 1)
            self.low[upper] += least - values[cut]
            self.at[upper] = least - self.moved

    def _join(self) -> None:
        width = np.append(self.low[1:], self.beyond) - self.low
        self.slope[width == 1] = 0
        alike = (self.at[1:] == self.at[:-1] + self.slope[:-1] * width[:-1]) & (self.slope[1:] == self.slope[:-1])
        for ids in (self.events, self.sales):
            for applied in ids.values():
                alike &= applied[1:] == applied[:-1]
        if alike.any():
            self._take(np.flatnonzero(np.append(True, ~alike)))

    def _take(self, pieces: np.ndarray) -> None:
        self.low, self.at, self.slope = self.low[pieces], self.at[pieces], self.slope[pieces]
        for ids in (self.events, self.sales):
            for name in ids:
                ids[name] = ids[name][pieces]

    def _one(self, columns: dict[str, np.ndarray], i: int) -> None:
        """A row whose ids occur elsewhere too; see ``BalanceRun._one``."""
        is_sale, event_id = columns["must_exist"][i], columns["_again_event_id"][i]
        sale_id = columns["_again_sale_id"][i]

        def used(ids: dict[str, np.ndarray], name: str | None, blocked: bool) -> np.ndarray:
            none = np.zeros(len(self.low), bool)
            return ~none if blocked else ids.get(name, none)

        def idle() -> np.ndarray:
            taken = used(self.events, event_id, columns["_blocked_event_id"][i])
            return taken | used(self.sales, sale_id, columns["_blocked_sale_id"][i]) if is_sale else taken

        applied = self._apply(int(columns["delta"][i]), idle)
        for ids, name in ((self.events, event_id), (self.sales, sale_id if is_sale else None)):
            if name is not None and applied.any():
                ids[name] = ids.get(name, np.zeros(len(self.low), bool)) | applied


@dataclass(frozen=True)
class DedupKernel:
    """Alert suppression anchored at the last created alert; the window does not slide.

    A row at time ``t`` is absorbed when the anchor is at or after ``t - window``; otherwise it is created and
    becomes the anchor.
    """

    window_micros: int

    inputs = ("at_micros",)
    defaults = {}
    ids = ()
    outputs = (("created", T.BooleanType(), pa.bool_()), ("anchor_micros", T.LongType(), pa.int64()))
    absent = -4 * FAR

    def begin(self, state: int | None) -> DedupRun:
        return DedupRun(self.absent if state is None else state, self.window_micros)

    def limit(self) -> None:
        return None

    def function(self, most: int) -> DedupFunction:
        return DedupFunction(self.window_micros)

    def room(self, rows: int) -> tuple[np.ndarray, ...]:
        return np.zeros(rows, bool), np.zeros(rows, np.int64)

    def arrays(self, out: tuple[np.ndarray, ...]) -> list[pa.Array]:
        return [pa.array(out[0]), pa.array(out[1])]


class DedupRun:
    def __init__(self, start: int, window: int) -> None:
        self.state = start
        self.window = window

    def advance(self, columns: dict[str, np.ndarray], low: int, high: int, out: tuple[np.ndarray, ...] | None) -> None:
        size = _SHORT
        while low < high:
            edges = columns["at_micros"][low:min(high, low + size)] - self.window
            later = edges > self.state
            n = int(later.argmax()) if later.any() else len(edges)
            if out is not None:
                out[1][low:low + n] = self.state
            low += n
            size = min(2 * size, _LONG)
            if n < len(edges):
                self.state = int(edges[n]) + self.window
                if out is not None:
                    out[0][low], out[1][low] = True, self.state
                low, size = low + 1, _SHORT


class DedupFunction:
    """The last anchor of a stretch for every anchor it may start with. The rows must come in the order of time."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.times: list[np.ndarray] = []

    def advance(self, columns: dict[str, np.ndarray], low: int, high: int, out=None) -> None:
        self.times.append(np.asarray(columns["at_micros"][low:high], np.int64))

    def is_full(self) -> bool:
        return False

    def pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        times = np.concatenate(self.times)
        if (np.diff(times) < 0).any():
            raise ValueError("a hot key can only be deduplicated in the order of time")
        times = np.unique(times)
        # From an anchor at one time the next is the first one beyond its window, and so on to the last.
        chain = np.searchsorted(times, times + self.window, "right")
        chain = np.where(chain < len(times), chain, np.arange(len(times)))
        while (chain[chain] != chain).any():
            chain = chain[chain]
        # A start up to the window before a row makes that row an anchor; one within reach of all rows stays.
        lows = np.concatenate([[DedupKernel.absent], times - self.window])
        ends = np.append(times[chain], times[-1] - self.window)
        slopes = np.append(np.zeros(len(times), np.int64), 1)
        fresh = np.append(True, (ends[1:] != ends[:-1]) | (slopes[1:] != slopes[:-1]))
        return lows[fresh], ends[fresh], slopes[fresh]
