"""Catalogue analytics on Spark: DataFrame operators over product, shop, word and page tables."""
