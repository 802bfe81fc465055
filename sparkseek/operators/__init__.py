"""sparkseek.operators"""
