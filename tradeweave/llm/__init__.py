"""Operations for preparing training text: sharding, token counts, deduplication, archives,
license scans, encoding, exact search, quality scores, personal data and contamination.

Nothing outside this folder imports it.
"""
