from .bases import canonical, kmer_pack, kmer_unpack, normalized, register_functions, revcomp, segments

__all__ = ["canonical", "kmer_pack", "kmer_unpack", "normalized", "register_functions", "revcomp", "segments"]
