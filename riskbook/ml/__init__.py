"""Distributed model fitting and scoring (GLMs, M-hat ensemble, attribution)."""
