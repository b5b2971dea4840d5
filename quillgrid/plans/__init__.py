"""quillgrid.plans."""
