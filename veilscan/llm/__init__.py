"""Operators for building training corpora.

Each module holds one operator with its general interface; :mod:`veilscan.llm.registry` has the thin
``opN_<name>`` queries with production parameters.  Nothing outside this subpackage imports it.
"""

from __future__ import annotations
