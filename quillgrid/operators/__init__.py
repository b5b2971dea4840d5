"""quillgrid.operators."""
