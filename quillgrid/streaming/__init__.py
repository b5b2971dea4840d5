"""quillgrid.streaming."""
