"""Queries over the given tables, one module for each family of operators; importing this registers them all."""

from ledgerline.queries import base, files, portfolio_views, replaying, risk, scoring  # noqa: F401
