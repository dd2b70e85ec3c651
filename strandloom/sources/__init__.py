from .fastx import FastxSource, read_reads
from .kmerbin import KmerbinSource, read_header, read_result, write_result
from .textsink import write_dump, write_histogram

__all__ = ["FastxSource", "KmerbinSource", "read_header", "read_reads", "read_result", "write_dump", "write_histogram", "write_result"]
