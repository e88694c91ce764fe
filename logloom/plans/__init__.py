"""Registered queries over the driver's tables."""

from . import commits, conversations, documents, events, files, ledger, orders, snapshots  # noqa: F401  they register themselves
