"""quillgrid: form filling, label matching and document analytics as Spark plans."""
