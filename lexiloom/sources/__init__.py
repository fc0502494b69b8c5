"""Reading files, images and archives, and writing archives and files."""
