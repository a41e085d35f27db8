"""Schemas of the domain's tables."""

from __future__ import annotations

READS = "sample string, chr_idx int, pos long, mate_pos long, insert_size long, seq_len int, mapq int, flags int"
CONTIGS = "chr string, chr_idx int, length long, cum_offset long"
RATIO = "chr_idx int, win long, start long, coverage_ratio double, coverage_tumor double, coverage_tumor_adj double, coverage_normal double, coverage_normal_adj double"
HET_SNP = "chr string, pos long, tumor_depth int, tumor_ro int, tumor_ao int, normal_depth int, normal_ro int, normal_ao int"
SNPS = "chr_idx int, pos long, log_or double, coverage int"
SEGMENTS = "chr_idx int, start long, end long, ratio double, stddev double, n_windows long"
TRUTH = "chr_id int, start long, end long, cp double, major double, is_clonal boolean"

# SAM flag bits.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, FIRST, SECONDARY, DUPLICATE, SUPPLEMENTARY = 0x1, 0x2, 0x4, 0x8, 0x10, 0x40, 0x100, 0x400, 0x800
