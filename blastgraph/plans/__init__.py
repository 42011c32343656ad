"""Questions a responder asks, as functions from a graph to DataFrames."""
