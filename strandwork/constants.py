"""Schemas of inputs, and named defaults."""

from __future__ import annotations

# Schemas, as Spark DDL.
SEGMENTS = "chr string, start long, end long"
FRAGMENTS = "chr string, ref_start int, tlen int"
CHROM_SIZES = "chr string, size long"
FASTA_INDEX = "chr string, length long, offset long, linebases int, linewidth int"
BED3 = "chr string, start int, end int"
BED6 = "chr string, start int, end int, name string, score int, strand string"
GTF = "seqname string, source string, feature string, start long, end long, score string, strand string, frame string, attributes string"
TSS = "chr string, ORF string, coordinate double"
GENES = "chr string, orf string, strand int, plus1 long, minus1 long, tss long, tts long, orf_start long, orf_end long"
SITE_SCORES = "start long, end long, width int, score double, tf string, chr string"
MOTIFS = "motif string, pos int, base string, prob double"

# Sizes in bases, thresholds and counts that results depend on.
LONG_FRAGMENT = (127, 187)
SHORT_FRAGMENT = (0, 80)
NUCLEOSOME = 147
HALF_NUCLEOSOME = 73
DYAD_REACH = 58
LINKER = 15
SITE_REACH = 5
ATAC_OFFSET = 4
POSTERIOR_CUT = 1e-4
EM_ROUNDS = 10
EM_SEGMENTS = 500
EM_SEED = 9
BACKGROUND_CONC = 1.0
NUCLEOSOME_CONC = 35.0
UNKNOWN_LENGTH = 10
NB_FALLBACK = (0.002, 100.0)
NB_EXCLUDED_CHR = "chrXII"
SITE_FLOOR = 1e-10
LINK_TOLERANCE = 73
LINK_MIN_OCCUPANCY = 0.1
SHIFT_THRESHOLD = 20
DYAD_MARK = 25
PLUS_MINUS_REACH = 50
PROMOTER_REACH = 2000
DOWNSTREAM_REACH = 500
SITE_MIN_SCORE = 0.1
TABLE_MIN_PERCENT = 10.0
DIFF_P = 0.05
DIFF_ABS = 1e-3
KMEANS_ROUNDS = 50
DINUCLEOTIDE_SAMPLE = 5000
