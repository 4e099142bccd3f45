"""The corpus pipeline: five stages over documents, each written and read again."""

from goldmatch.llm.stages import STAGES, drop_repeated_lines, keep_first_copies, keep_good, mix_sources, pack_sequences, run

ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "drop_repeated_lines", "keep_first_copies", "keep_good", "mix_sources", "pack_sequences", "run"]
