"""A driver-side cursor over an ordered query, which fetches bounded pages rather than running a job a row."""

from __future__ import annotations

from pyspark.sql import Row

from .functions.ids import join_token
from .plans.compile import Options, Plan


class Cursor:
    """first/last/next/prev/seek/seek_reverse return a row or None at the end."""

    def __init__(self, plan: Plan, keep: tuple[str, ...] = (), page: int = 256):
        self._plan, self._keep, self._page = plan, keep, page
        self._token: str | None = None
        self._ahead: list[Row] = []
        self._backward = False

    def _fetch(self, token: str, reverse: bool, inclusive: bool = False) -> Row | None:
        rows = self._plan.after(self._plan.rows(self._keep), token, reverse, inclusive)
        self._ahead = rows.orderBy(*self._plan.order(reverse)).limit(self._page).collect()[::-1]
        self._backward = reverse
        return self._take()

    def _take(self) -> Row | None:
        if not self._ahead:
            return None
        row = self._ahead.pop()
        self._token = join_token(row.rel_id if self._plan.by_rel_id else "", row.id)
        return row

    def first(self) -> Row | None:
        return self._fetch("", False)

    def last(self) -> Row | None:
        return self._fetch("", True)

    def _step(self, reverse: bool) -> Row | None:
        if self._token is None:
            return self._fetch("", reverse)
        if self._ahead and self._backward == reverse:
            return self._take()
        return self._fetch(self._token, reverse)

    def next(self) -> Row | None:
        return self._step(False)

    def prev(self) -> Row | None:
        return self._step(True)

    def seek(self, token: str) -> Row | None:
        """The smallest key at or after the token."""
        return self._fetch(token, False, inclusive=True)

    def seek_reverse(self, token: str) -> Row | None:
        """The greatest key at or before the token."""
        return self._fetch(token, True, inclusive=True)

    def has(self, entry_id: str) -> bool:
        """Whether the entry passes every filter in the sense that a later filter has."""
        plan = self._plan
        entries = plan.entries.where(plan.entries["id"] == entry_id)
        rows = Plan(entries, plan.spec, []).rows()
        for f in plan.filters:
            rows = Plan(entries, plan.spec, [], plan.index)._semi(rows, f)
        return not rows.limit(1).isEmpty()


__all__ = ["Cursor", "Options"]
