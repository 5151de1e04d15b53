"""Strandwork: occupancy analytics over genomic signal, written as Spark DataFrame jobs."""
