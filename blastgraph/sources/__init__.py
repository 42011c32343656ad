"""Readers that turn raw documents or tables into graph rows."""
