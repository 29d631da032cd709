"""See ``broadsheet.memory``."""

from broadsheet.memory import BLOCK, PAGES, TRIM, give_back, trim  # noqa: F401
