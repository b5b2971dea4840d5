"""quillgrid.functions."""
