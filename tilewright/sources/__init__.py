"""Readers and writers of annotations, images, COCO tables and configurations."""
