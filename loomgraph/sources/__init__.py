"""Edge files: binary and text readers and writers, converters, generators."""
