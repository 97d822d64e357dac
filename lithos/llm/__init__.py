"""Operators for building large text-training corpora.

Nothing outside this folder imports it.  Each ``opN_*`` module holds one
operator with its own general interface; :mod:`lithos.llm.queries` derives the
registered queries from them.
"""
