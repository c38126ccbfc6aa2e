"""How operators cut lineage: tables in the folder that the session names as shared."""

from __future__ import annotations

from linkloom.tables import Scratch, folder, mounted, remove, settle  # noqa: F401
