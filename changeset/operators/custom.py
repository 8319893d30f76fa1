"""Operations of the caller's own inside a static patch."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column

from .ops import Operation


class Handler(Protocol):
    """What an operation does to the value at its path. Only apply is needed.

    check(current) -> whether a strict patch may go ahead; resolve(current, proposed) -> what is set instead;
    reverse() -> the handler that undoes this one; summary(path) -> a line of text; to_json() -> its wire form.
    """

    def apply(self, current: Column) -> Column: ...


@dataclass(frozen=True)
class CustomOperation(Operation):
    """kind custom; new holds the handler."""

    def checked(self, current: Column) -> Column | None:
        check = getattr(self.new, "check", None)
        return check(current) if check else None

    def applied(self, current: Column) -> Column:
        proposed = self.new.apply(current)
        resolve = getattr(self.new, "resolve", None)
        return resolve(current, proposed) if resolve else proposed

    def reversed(self) -> Operation:
        """The operation that undoes this one; one whose handler can't say how raises."""
        back = getattr(self.new, "reverse", None)
        if back is None:
            raise ValueError(f"{self.path}: the operation can't be reversed")
        return CustomOperation("custom", self.path, new=back())

    def line(self) -> str:
        summary = getattr(self.new, "summary", None)
        return summary(self.path) if summary else f"Custom {self.path}"

    def wire(self) -> dict:
        """Its RFC 6902 object; one whose handler has no wire form raises."""
        to_json = getattr(self.new, "to_json", None)
        if to_json is None:
            raise ValueError(f"{self.path}: the operation has no wire form")
        return {"op": "custom", "path": self.path, "value": to_json()}


def custom(path: str, handler: Handler) -> CustomOperation:
    return CustomOperation("custom", path, new=handler)
