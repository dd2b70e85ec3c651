from .counting import dump, exported, histogram, histogram_totals, merged_counts, raw_counts, statistics
from .kmers import kmer_codes, kmers, pieces

__all__ = ["dump", "exported", "histogram", "histogram_totals", "kmer_codes", "kmers", "merged_counts", "pieces", "raw_counts", "statistics"]
