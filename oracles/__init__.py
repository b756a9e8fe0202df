"""The same reports in DuckDB SQL over the sample tables, written the direct way.

Nothing is pre-aggregated here: items meet reviews row by row, ranks are plain windows.
Amounts are whole cents until the last step; ``ratio`` rounds in integers.
"""
