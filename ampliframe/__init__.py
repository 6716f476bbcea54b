"""A PySpark engine for multiplexed PCR primer design over sequence alignments."""
