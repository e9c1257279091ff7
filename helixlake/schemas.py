"""Schemas of the engine's tables, as DDL strings."""

from __future__ import annotations

#: One sequence; chr numbers are unique over all input files, file_idx 0 is the reference side.
SEQUENCES = "chr int, file_idx int, description string, seq string"
#: A condensed graph edge; positions are 0-based on the positive strand.
EDGES = "chr int, strand int, start_vertex long, end_vertex long, actual_pos int, actual_len int, orig_pos int, orig_len int, first_char string"
#: A block instance: half-open 0-based [start, end) on the positive strand, sign of the strand.
BLOCKS = "block_id int, sign int, chr int, `start` int, `end` int"
#: Two gapped rows of equal length.
ALIGNED = "pair_id long, a string, b string"
#: A local hit between two sequences of a pair.
HITS = "pair_id long, s1 int, e1 int, s2 int, e2 int, score double, strand string"
#: A called variant; missing values are null and become '.' in a sink only.
VARIANTS = "chr string, pos int, contig string, assembly_pos int, ref string, alt string, block_id int"
