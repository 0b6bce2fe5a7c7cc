"""Case schema: which columns of a table play which role."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class CaseSchema:
    """Roles of the columns of a case table.

    ``id`` identifies a case (position does not exist in Spark, so it is
    required).  ``numeric`` and ``nominal`` are feature columns; ``target`` is
    the column to predict.
    """

    id: str
    target: str
    numeric: tuple[str, ...] = field(default_factory=tuple)
    nominal: tuple[str, ...] = field(default_factory=tuple)

    @property
    def features(self) -> tuple[str, ...]:
        return tuple(self.numeric) + tuple(self.nominal)
