"""Runs of equal keys in sorted Arrow batches, with bounded memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def complete_runs(batches, limit: int | None) -> Iterator[tuple[list[np.ndarray] | None, int | None]]:
    """(columns, None) with whole runs of the rows of `batches`, which are sorted by their first column; (None, key) for a
    run of more than `limit` rows, of which no more than that and a batch are held. Keys are integers."""
    held: list[list[np.ndarray]] = []
    over = None

    def joined() -> list[np.ndarray]:
        return held[0] if len(held) == 1 else [np.concatenate(x) for x in zip(*held)]

    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if over is not None and len(cols[0]):
            at = int(np.searchsorted(cols[0], over, "right"))
            cols = [c[at:] for c in cols]
        if not len(cols[0]):
            continue
        over = None
        held.append(cols)
        last = cols[0][-1]
        if held[0][0][0] != last:
            rows = joined()
            done = int(np.searchsorted(rows[0], last))
            yield [c[:done] for c in rows], None
            held = [[c[done:] for c in rows]]
        if limit is not None and sum(len(x[0]) for x in held) > limit:
            yield None, int(last)
            over, held = last, []
    if held:
        yield joined(), None
