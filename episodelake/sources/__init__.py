"""Reading tables, and the two rules that every operator on them shares: copies count once, the latest row is current."""

from episodelake.sources.tables import current, once, shared_folder, table

__all__ = ["current", "once", "shared_folder", "table"]
