"""Queries over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from calibrant.plans import caches, calibration, evaluation, io, refresh, signals, streams, text

PLANS: list = [evaluation, text, signals, calibration, refresh, streams, io, caches]
