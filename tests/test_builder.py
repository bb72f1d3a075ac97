from folioforge.operators import review, write_text
from folioforge.sources.builder import DocumentBuilder
from folioforge.sources.model import plain_text
from folioforge.sources.packages import read_docx, read_odt, write_docx, write_odt


def sample():
    return (
        DocumentBuilder().title("T").author("A").toc(2).heading(1, "One").heading(3, "Deep").heading(2, "Two")
        .paragraph(lambda p: p.text("a ").bold("b").tab().italic("c").line_break().link("d", "http://e").bookmark("m", "f"))
        .numbered("x", start=3).numbered("y").paragraph("between").numbered("z").bullet("dot").page_break().table([["h", "i"], ["1", ""]], header=True).build()
    )


def test_builder_and_exports():
    doc = sample()
    assert plain_text(doc).startswith("One\nDeep\nTwo\na b\tc\ndf\nx\ny\nbetween\nz\ndot\n")
    assert write_text.to_text(doc).split("\n")[5:12] == ["3. x", "4. y", "between", "1. z", "- dot", "---", ""]
    assert "3. x\n4. y\n\nbetween\n\n1. z\n- dot" in write_text.to_markdown(doc)
    assert write_text.to_csv(doc) == "h,i\r\n1,\r\n"


def test_toc_and_round_trips():
    doc = sample()
    assert review.update_toc(doc) == 1
    toc = doc.body.kids[0]
    assert [(p.attrs["style_id"], p.plain()) for p in toc.kids] == [("TOC1", "One"), ("TOC2", "Two")]
    for again in (read_docx(write_docx(doc)), read_odt(write_odt(doc))):
        assert again.meta["title"] == "T" and again.body.kids[0].kind == "TableOfContents"
        assert [p.plain() for p in again.body.kids[0].kids] == ["One", "Two"] and plain_text(again) == plain_text(doc)
    assert review.headings(doc) == [(1, "One"), (3, "Deep"), (2, "Two")]


def test_tracked_changes():
    def changed():
        doc = DocumentBuilder().paragraph("").build()
        p = doc.body.kids[0]
        p.run("keep ")
        p.run("new ", revision_type="Insert", revision_author="ann")
        p.run("old", revision_type="Delete", revision_author="bob")
        p.run("moved", revision_type="MoveTo")
        return doc

    assert review.tracked_changes(changed()) == [("Insert", "ann", "new "), ("Delete", "bob", "old"), ("MoveTo", "", "moved")]
    for accept, want in ((True, "keep new moved"), (False, "keep oldmoved")):
        doc = changed()
        assert review.decide_changes(doc, accept) == 3 and plain_text(doc) == want and not review.tracked_changes(doc)
