"""quillgrid.sources."""
