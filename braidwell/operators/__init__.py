"""Retrieval, lineage, fusion, selection and expansion."""
