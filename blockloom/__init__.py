"""blockloom: block-oriented data integrity and byte analytics on Spark.

Files, binary columns and text columns are relations of fixed-size blocks;
digests, manifests, repair, comparison, copying and search are DataFrame
plans over those relations.
"""

__version__ = "0.1.0"
