"""Named queries over the test tables, each with its SQL."""

from sparloom.plans import custom, flows, more, programs, queries, search, texts  # noqa: F401
