"""DuckDB oracle SQL: stand-in entity CTEs and one query per registered model.

Only the raw tables are registered as views in the checker, so every query
carries the entity definitions it needs as CTEs.
"""

from .models import SQL as _MODELS

SQL: dict[str, str] = {}
SQL.update(_MODELS)

from .dashboards import SQL as _DASH  # noqa: E402

SQL.update(_DASH)

from .experiment import SQL as _EXP  # noqa: E402

SQL.update(_EXP)

from .quality import SQL as _DQ  # noqa: E402

SQL.update(_DQ)

from .landing import SQL as _LAND  # noqa: E402

SQL.update(_LAND)

from .segmentation import SQL as _SEG  # noqa: E402

SQL.update(_SEG)

from .audits import SQL as _AUD  # noqa: E402

SQL.update(_AUD)

from .entities import SQL as _ENT  # noqa: E402

SQL.update(_ENT)
