"""Writers: interchange formats, reports and container files."""
